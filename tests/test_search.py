"""What SQL can't say: stems, sections, parts of notes, claims, links and embedding runs against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quern.functions.stemming import stem, stems
from quern.operators import graph as G
from quern.operators import matching as M
from quern.operators import search as S
from quern.plans.registry import QUERIES


@pytest.mark.parametrize(
    ("word", "expected"),
    # pairs of the published description of the algorithm
    [x.split(":") for x in (
        "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size"
        " hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc"
        " digitizer:digit radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis"
        " hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr"
        " hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac"
        " adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler"
        " probate:probat rate:rate cease:ceas controll:control roll:roll at:at").split()],
)
def test_porter(word, expected):
    assert stem(word) == expected


def test_stems_of_a_vocabulary(spark):
    got = stems(spark.createDataFrame([("running",), ("runs",), ("running",), (None,)], "term string")).collect()
    assert sorted((r.term, r.stem) for r in got) == [("running", "run"), ("runs", "run")]


def test_stemmed_search_finds_other_forms(spark):
    from quern.operators.ranking import bm25

    docs = spark.createDataFrame([(1, "connected wires"), (2, "connection lost"), (3, "other things entirely"), (4, "more of nothing"), (5, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "connecting")], "query_id long, text string")
    assert bm25(docs, asked).count() == 0
    assert sorted(r.doc_id for r in bm25(docs, asked, stemmed=True).collect()) == [1, 2]


def section(text, topic):
    found, current = [], None
    for line in text.split("\n"):
        if line.startswith(("## ", "### ")):
            current = [line] if topic.lower() in line.lower() else None
            if current:
                found.append(current)
        elif current is not None:
            current.append(line)
    if found:
        return "\n\n".join("\n".join(x) for x in found)
    hits = [x for x in text.split("\n") if topic.lower() in x.lower()]
    return "\n".join(hits[:30]) if hits else text[:2000]


@pytest.mark.parametrize("topic", ["beta", "GAMMA", "only here", "nothing", "intro"])
def test_topic_sections(spark, topic):
    text = "# Title\nintro\n## Alpha beta\na\n\nb\n### Gamma\nc only here\n## Beta\nd\n" + "x" * 3000
    got = spark.createDataFrame([(text, topic)], "t string, k string").select(S.topic_sections(F.col("t"), F.col("k")).alias("s")).first().s
    assert got == section(text, topic)


def test_guide_topics_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    guides = {}
    for r in rows:
        guides.setdefault(r.conv_id, []).append(f"## {r.role} part\n{r.text}")
    expected = {k: hashlib.sha256(section("# Guide\nintro\n" + "\n".join(v), ["USER", "intro", "nowhere at all"][k % 3]).encode()).hexdigest() for k, v in guides.items()}
    assert {r.conv_id: r.section_hash for r in QUERIES["guide_topics"](spark, sf_dir).collect()} == expected


def parts(text, stem, most=2000, least=500):
    heads = list(re.finditer(r"^(#{1,2})[ \t]+(\S.*)$", text, re.M))
    if len(text.encode()) <= most or not heads:
        return [(stem, text)]
    bounds = [m.start() for m in heads] + [len(text)]
    found = [(re.sub("-{2,}", "-", re.sub(r"[\s_]+", "-", re.sub(r"[^a-z0-9\s-]", "", m[2].strip().lower()))).strip("-")[:60], text[a:b].strip(" \t\r\n")) for m, a, b in zip(heads, bounds, bounds[1:], strict=False)]
    first = text[: heads[0].start()].strip(" \t\r\n")
    if first and len(first.encode()) >= least:
        found.insert(0, ("preamble", first))
    return [(stem, found[0][1])] if len(found) == 1 else [(f"{stem}-part-{k:02d}-{s}"[:100], t) for k, (s, t) in enumerate(found, 1)]


def test_heading_parts(spark):
    text = "p" * 600 + "\n# One two_three!\nbody\n## \nno heading\n## Four\n" + "y" * 2500 + "\n### deeper\nz"
    rows = [("a", text), ("b", "short\n# x"), ("c", "w" * 5000), ("d", "pre\n# Only\n" + "v" * 3000), ("e", text.replace("p" * 600, "p"))]
    df = spark.createDataFrame(rows, "stem string, text string")
    got = df.select("stem", S.split_at_headings(F.col("text"), F.col("stem"), 2000).alias("p")).collect()
    assert {r.stem: [(x.stem, x.text) for x in r.p] for r in got} == {s: parts(t, s) for s, t in rows}


def test_heading_parts_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = sorted((d.doc_id, s, len(t)) for d in docs if d.text is not None for s, t in parts(d.text.replace("\n", "\n## "), f"doc-{d.doc_id}"))
    assert sorted((r.doc_id, r.stem, r.n) for r in QUERIES["heading_parts"](spark, sf_dir).collect()) == expected


def test_claims_query(spark, sf_dir):
    """The three best sentences of each answer, found again in Python."""

    def best(text):
        sentences = [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text.strip(" ")) if s.strip(" ")]
        score = lambda s: (len(re.findall(r"\b[A-Z][a-z]+", s, re.A)) + 0.6 * len(re.findall(r"(?i)\b(?:must|will|shall|always|never|is|are)\b", s, re.A))) / max(8, len(s.split()))
        return [k for k, s in sorted(enumerate(sentences), key=lambda x: (-score(x[1]), x[0]))][:3]

    turns = [r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect() if r.role == "assistant"]
    got = {}
    for r in QUERIES["claims_topn"](spark, sf_dir).orderBy("rank").collect():
        got.setdefault((r.conv_id, r.turn), []).append(r.pos)
    plain = [t for t in turns if t.text.isascii()]
    assert plain and all(got.get((t.conv_id, t.turn), []) == best(t.text) for t in plain)


def test_links_query(spark, sf_dir):
    """The first whole word of each name is linked once."""

    def linked(text):
        for name in ("the", "and"):
            if f"[[{name}" not in text:
                text = re.sub(rf"\b{name}\b", f"[[{name}]]", text, count=1)
        return text

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.linked_hash for r in QUERIES["wikilink_injection"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    plain = [i for i, t in docs.items() if t and t.isascii()]
    assert len(plain) > 100 and all(got[i] == hashlib.sha256(linked(docs[i]).encode()).hexdigest() for i in plain)


def test_embedding_runs(spark):
    seen = []

    def provider(texts):
        seen.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(x)), 0.0] for x in texts]

    assert S.embedded(["a", "bb", "bad", "cccc"], provider) == [[1.0, 0.0], [2.0, 0.0], None, [4.0, 0.0]]
    assert seen == [4, 2, 2, 1, 1]
    assert S.embedded(["a", "b"], lambda texts: [[1.0]]) == [[1.0], [1.0]]
    chunks = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    done = S.embed(chunks, lambda texts: [[1.0, 0.0] for _ in texts], 2)
    assert S.embed_report(done).first().asDict() == {"embedded": 2, "failed": 0}
    with pytest.raises(Exception, match="components"):
        S.embed(chunks, lambda texts: [[1.0] for _ in texts], 2).collect()
    assert S.embed_report(S.embed(chunks.limit(0), provider, 2)).first().embedded == 0


def test_scopes_without_agents(spark):
    none = spark.createDataFrame([], "agent string, collections array<string>")
    asked = spark.createDataFrame([("shared", "a"), ("agent", "a"), ("agent", None)], "scope string, agent string")
    got = {(r.scope, r.agent): r.collections for r in S.resolve_scopes(asked, none, ["docs"]).collect()}
    assert got == {("shared", "a"): ["docs"], ("agent", "a"): ["a-memory"], ("agent", None): None}
    with pytest.raises(ValueError, match="registry"):
        S.resolve_scopes(spark.createDataFrame([("everything", "a")], "scope string, agent string"), none, [])


def test_gold_lists_at_the_edges(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranked = spark.createDataFrame([(1, 1, "a/B c.md"), (1, 2, "a/B c.md"), (1, 3, "x/b-c.md"), (2, 1, "q.md")], "query_id long, rank int, path string")
    gold = spark.createDataFrame([(1, 1, "b_c", 2), (1, 2, "a/b-c.md", 1), (3, 1, "z", 1), (1, 3, None, 1)], "query_id long, pos int, ref string, rel int")
    got = {r.query_id: (r.ndcg, r.hit, r.rr) for r in M.graded(asked, ranked, gold).collect()}
    assert got[2] == (0.0, 0, 0.0) and got[3] == (0.0, 0, 0.0) and got[1][1:] == (1, 1.0)
    assert got[1][0] == pytest.approx((2 + 2 / 1.584962500721156) / (2 + 1 / 1.584962500721156 + 0.5), abs=1e-6)


def test_edges_with_null_labels_are_not_valid(spark):
    rows = [("a", "Person", "b", "Concept", "KNOWS"), ("a", None, "b", "Concept", "KNOWS"), ("a", "Person", "b", "Concept", None), ("a", "Person", " ", "Concept", "KNOWS")]
    good, bad = G.valid_edges(spark.createDataFrame(rows, "from_id string, from_label string, to_id string, to_label string, kind string"), ["KNOWS"])
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no to_id", "unknown kind", "unknown label"]


def test_samples_need_no_sorted_group(spark, monkeypatch):
    import hashlib

    from quern.operators import evaluation as E

    rows = [("ab"[k % 7 == 0], k) for k in range(5000)] + [("c", 1), ("c", None), ("d", 5), (None, 6)]
    shares = [("a", 40), ("b", 700), ("c", 5), ("d", 0), ("e", 3)]
    df, wanted = spark.createDataFrame(rows, "g string, k long"), spark.createDataFrame(shares, "g string, share long")
    order = lambda k: ("" if k is None else hashlib.md5(str(k).encode()).hexdigest(), k or 0)
    expected = sorted((g, k or -1) for g, n in shares for k in sorted((k for h, k in rows if h == g), key=order)[:n])
    for few in (E.FEW, 1):
        monkeypatch.setattr(E, "FEW", few)
        assert sorted((r.g, r.k or -1) for r in E.stratified(df, wanted, "g", "k").collect()) == expected
    same = spark.createDataFrame([("a", 3)] * 50, "g string, k long")
    assert E.stratified(same, wanted, "g", "k").count() == 40


def test_rows_are_numbered_over_ranges(spark):
    from quern.shared import numbered

    got = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 AS x").repartition(7), "x").collect()
    assert sorted((r.x, r["rank"]) for r in got) == [(k, k + 1) for k in range(1000)]
    assert numbered(spark.range(0), "id").count() == 0


def test_fields_books_and_accents(spark):
    from quern.functions.text import book_body, folded, with_frontmatter

    rows = [("---\ntitle: x\nother: y\n---\n\n\n body\n",), ("plain",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(with_frontmatter(F.col("t"), {"title": F.lit('A "b"\nc'), "source": F.lit(None)}).alias("r"))
    head = '---\ntitle: "A \\"b\\" c"\nsource: \n---\n\n'
    assert [r.r for r in df.collect()] == [head + "body\n", head + "plain", head, head]
    books = [("front *** START OF THE PROJECT GUTENBERG EBOOK X ***\n tale *** END OF THIS PROJECT GUTENBERG EBOOK *** licence", "tale"), ("a ***start of project gutenberg*** b", "b"), ("b *** END OF PROJECT GUTENBERG *** c", "b"), (" no marks ", "no marks"), (None, None), ("", "")]
    assert [(r.a, r.b) for r in spark.createDataFrame(books, "t string, b string").select(book_body(F.col("t")).alias("a"), "b").collect()] == [(b, b) for _, b in books]
    assert [r[0] for r in spark.createDataFrame([("Crème brûlée Ñandú é ß ø",), (None,)], "t string").select(folded(F.col("t"))).collect()] == ["Creme brulee Nandu e ß ø", None]
