"""Ingest and curation of a corpus: scans, upserts, pending work, filters, duplicates, dates, rule classes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import cut, small


def scan_diff(known: DataFrame, seen: DataFrame, keys: Sequence[str] = ("collection", "path"), faithful: bool = False) -> DataFrame:
    """(keys, hash, action): new, updated, unchanged, removed, or duplicate (new, with a hash that was known before).

    ``known`` and ``seen`` are (keys, hash). With ``faithful`` a moved file is a duplicate of its old place, which is
    removed in the same scan; without it the hash must be that of a row that stays.
    """
    old = known.select(*keys, F.col("hash").alias("old_hash"))
    both = old.join(seen.select(*keys, F.col("hash").alias("new_hash")), list(keys), "full_outer")
    action = (
        F.when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    )
    rows = both.withColumn("action", action)
    before = rows.where(F.col("old_hash").isNotNull()) if faithful else rows.where(F.col("action") == "unchanged")
    hashes = before.select(F.col("old_hash").alias("_known")).distinct()
    marked = rows.join(hashes, F.col("new_hash") == F.col("_known"), "left")
    return marked.select(
        *keys, F.coalesce("new_hash", "old_hash").alias("hash"),
        F.when((F.col("action") == "new") & F.col("_known").isNotNull(), "duplicate").otherwise(F.col("action")).alias("action"),
    )


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with rows of ``changes`` in place of those with the same keys."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes.select(*current.columns))


def soft_delete(current: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with ``active`` 0 where no row of ``seen`` has the keys."""
    marks = seen.select(*keys).distinct().withColumn("_seen", F.lit(1))
    joined = current.join(marks, list(keys), "left")
    return joined.withColumn("active", F.when(F.col("_seen").isNull(), 0).otherwise(F.col("active"))).select(*current.columns)


def pending(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """(hash, path): contents of active documents without a vector for their first chunk; of several paths the smallest."""
    done = vectors.where(F.col("seq") == 0).select("hash")
    waiting = documents.where((F.col("active") == 1) & (F.length("text") > 0)).join(done, "hash", "left_anti")
    return waiting.groupBy("hash").agg(F.min("path").alias("path"))


def latest_dates(chunks: DataFrame, documents: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(path, chunk_date): the latest date of documents whose path ends in a suffix; each suffix is a whole file name or more.

    Suffixes meet paths of the same last part, an equality that a shuffle can serve, and are then compared in full.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    dated = chunks.where(F.col("chunk_date").isNotNull()).join(documents.select("hash", "path"), "hash").withColumn("_last", last(F.col("path")))
    asked = suffixes.select("suffix", last(F.col("suffix")).alias("_last")).distinct()
    met = dated.join(asked, "_last").where(F.expr("endswith(path, suffix)"))
    return met.groupBy("path").agg(F.max("chunk_date").alias("chunk_date"))


def in_window(chunks: DataFrame, documents: DataFrame, start: str | None, end: str | None) -> DataFrame | None:
    """Distinct paths with a chunk dated from ``start`` to ``end``; an open end is None, both None no filter at all."""
    if start is None and end is None:
        return None
    day = F.col("chunk_date")
    fits = F.lit(True)
    if start is not None:
        fits = fits & (day >= F.lit(start).cast("date"))
    if end is not None:
        fits = fits & (day <= F.lit(end).cast("date"))
    return chunks.where(fits).join(documents.select("hash", "path"), "hash").select("path").distinct()


#: Names and parts of paths of files that carry no content of their own, and parts of translations (fixed values).
BOILERPLATE_NAMES = (
    "contributing.md code_of_conduct.md security.md changelog.md changes.md codeowners license license.md license.txt licence licence.md copying"
    " pull_request_template.md issue_template.md bug_report.md feature_request.md .gitignore .gitattributes .editorconfig .prettierrc .eslintrc.md"
    " dependabot.yml renovate.json"
).split()
BOILERPLATE_PARTS = (
    ".github/ .github\\ node_modules/ __pycache__/ .venv/ vendor/ dist/ build/ _build/ .next/ .docusaurus/ .cache/ site-packages/".split()
)
TRANSLATION_PARTS = "translations/ i18n/ /cn/ /zh/ /ja/ /ko/ /fr/ /de/ /es/ /pt/ /ru/ /ar/ /hi/ /it/ /tr/ /pl/ /vi/ /th/ /id/".split()


def _holds(path: Column, parts: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in parts]), lambda x: F.contains(path, x))


def boilerplate(path: Column) -> Column:
    """A file name, in any case, or a folder that holds no content of its own."""
    return F.lower(F.substring_index(path, "/", -1)).isin(BOILERPLATE_NAMES) | _holds(path, BOILERPLATE_PARTS)


def translation(path: Column) -> Column:
    return _holds(F.lower(path), TRANSLATION_PARTS)


def included(files: DataFrame, sources: DataFrame, most_tier: int = 3) -> DataFrame:
    """Files (source, path, ...) to keep: no boilerplate, no translation, none that its source excludes, of a tier that may be used.

    ``sources`` is (source, tier, excludes): one narrow row a source.
    """
    rules = sources.select("source", "tier", F.coalesce("excludes", F.array().cast("array<string>")).alias("_excludes"))
    joined = files.join(rules, "source").where(F.col("tier") <= most_tier)
    path = F.col("path")
    return joined.where(~boilerplate(path) & ~translation(path) & ~F.exists("_excludes", lambda x: F.contains(path, x))).drop("_excludes", "tier")


def within_paths(rows: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Rows of these paths; None or no paths at all filter nothing."""
    if paths is None or paths.isEmpty():
        return rows
    return rows.join(paths.select("path").distinct(), "path", "left_semi")


def owners(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """``documents`` with the ``owner`` whose write path begins theirs, null for none.

    Write paths (owner, write_path) don't begin one another. They end with a whole part of a path, so each path meets
    them by its own leading parts, in an equality join.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rules = registry.select(F.rtrim(F.col("write_path"), F.lit("/")).alias("_head"), F.col("owner").alias("_owner"))
    met = documents.select("path", F.explode(heads).alias("_head")).join(rules, "_head").groupBy("path").agg(F.min("_owner").alias("owner"))
    return documents.join(met, "path", "left")


def stale(sources: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """``sources`` (key, mtime) with ``stale``: never stored, or changed since."""
    seen = stored.select(key, F.col("mtime").alias("_stored"))
    return sources.join(seen, key, "left").withColumn("stale", F.coalesce(F.col("mtime") > F.col("_stored"), F.lit(True))).drop("_stored")


def size_class(text: Column, least: int = 500, most: int = 50_000) -> Column:
    n = F.octet_length(F.encode(F.btrim(text), "utf-8"))
    return F.when(n < least, "small").when(n > most, "split").otherwise("keep")


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """(hash, n, first_path) of contents that several documents share."""
    return documents.groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where(F.col("n") > 1)


def canonical(documents: DataFrame, by: str = "hash", length: Column | None = None) -> DataFrame:
    """(by, doc_id, path, n): of each group of duplicates the document with the longest body (``text``, or its ``length`` where that is known), then the smallest path."""
    longest = F.struct(-(F.length("text") if length is None else length), F.col("path"))
    return documents.groupBy(by).agg(F.min_by("doc_id", longest).alias("doc_id"), F.min_by("path", longest).alias("path"), F.count("*").alias("n"))


#: Texts, and characters of texts, that one side of a comparison holds about at most.
TILE, TILE_CHARS = 2_048, 8_000_000


def _run_codes(text: str, n: int = 3) -> np.ndarray:
    """The distinct runs of ``n`` characters of a text as numbers, none of a shorter one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) < n:
        return np.zeros(0, np.int64)
    return np.unique(sum(points[i : len(points) - n + 1 + i] << (21 * i) for i in range(n)))


def _with_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of runs of their ``text``; those without any go."""
    for batch in batches:
        sizes = np.array([len(_run_codes(t)) if t else 0 for t in batch.column("text").to_pylist()], np.int32)
        kept = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes)], [*batch.schema.names, "n"])
        yield kept.filter(pa.array(sizes > 0))


def _shared_runs(ids: np.ndarray, texts: list[str], side: np.ndarray, alone: bool, least: float) -> list[np.ndarray]:
    """(a, b, shared, n, m) of the pairs, of texts of sides 0 and 1 or ``alone`` of side 0, that may be alike; a < b."""
    runs = [_run_codes(t) for t in texts]
    sizes = np.array([len(x) for x in runs], np.int64)
    run, of = np.unique(np.concatenate(runs), return_inverse=True)
    doc = np.repeat(np.arange(len(runs)), sizes)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
    place = np.zeros(len(runs), np.int64)
    lists = []  # of each side: its texts by run, and where those of a run begin
    for rows in (one, two):
        place[rows] = np.arange(len(rows))
        mine = np.zeros(len(runs), bool)
        mine[rows] = True
        mine = mine[doc]
        order = np.argsort(of[mine], kind="stable")
        lists.append((place[doc[mine]][order], np.concatenate([[0], np.cumsum(np.bincount(of[mine], minlength=len(run)))])))
        if alone:
            lists *= 2
            break
    (rows_a, at_a), (rows_b, at_b) = lists
    met = np.diff(at_a) * np.diff(at_b)
    common = met * 256 > len(one) * len(two)
    shared = np.zeros((len(one), len(two)), np.float32)
    for r in np.flatnonzero(~common & (met > alone)).tolist():  # rare runs: the pairs that have them
        shared[rows_a[at_a[r] : at_a[r + 1], None], rows_b[at_b[r] : at_b[r + 1]]] += 1
    frequent = np.flatnonzero(common)
    for start in range(0, len(frequent), 4_096):  # the others: products of matrices
        some, made = frequent[start : start + 4_096], []
        for rows, at, height in ((rows_a, at_a, len(one)), (rows_b, at_b, len(two))):
            held = np.zeros((height, len(some)), np.float32)
            for k, r in enumerate(some.tolist()):
                held[rows[at[r] : at[r + 1]], k] = 1
            made.append(held)
        shared += made[0] @ made[1].T
    every = sizes[one][:, None] + sizes[two][None, :] - shared
    near = (shared > 0) & (shared >= (least - 1e-5) * every)
    if alone:
        near &= ids[one][:, None] < ids[two][None, :]
    x, y = np.nonzero(near)
    a, b = one[x], two[y]
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    return [ids[a], ids[b], shared[x, y].astype(np.int64), sizes[a], sizes[b]]


def near_duplicates(documents: DataFrame, block: str, least: float = 0.9, id_col: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of pairs in a block whose sets of three-character runs are alike. Ids are whole numbers; equal texts count once.

    Only texts of blocks that hold several rows are moved. A block of up to ``TILE`` texts is compared in one task. A larger one is
    dealt into classes by the number of runs, so wide that texts this alike lie in one class or in two next to each other, and classes
    into tiles: each pair of tiles is compared in a task of its own, which counts the runs that all pairs share and
    gives only the pairs that are alike.
    """
    given = documents.select(F.col(block).alias("block"), F.lower("text").alias("text"), F.col(id_col).cast("long").alias("id")).where("text IS NOT NULL")
    several = cut(given.groupBy("block").agg(F.count("*").alias("_n")).where((F.col("_n") > 1) & F.col("block").isNotNull()).select("block"))
    one = given.join(small(several), "block").groupBy("block", "text").agg(F.min("id").alias("id"))
    sized = cut(one.mapInArrow(_with_sizes, "block string, text string, id long, n int"))
    tiles = lambda: F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.length("text")) / TILE_CHARS)).cast("int")
    blocks = sized.groupBy("block").agg(tiles().alias("_tiles"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    step = -math.log(min(max(least, 0.01), 0.999)) * 1.001  # a little wider, as likenesses are rounded
    held = sized.join(small(blocks), "block").withColumn("class", F.when(F.col("_tiles") > 1, F.floor(F.log("n") / step)).otherwise(0).cast("int"))
    parts = cut(held.groupBy("block", "class").agg(tiles().alias("parts")))
    beside = lambda by, name: small(parts.select("block", (F.col("class") + by).alias("class"), F.col("parts").alias(name)))
    dealt = held.join(small(parts), ["block", "class"]).join(beside(1, "below"), ["block", "class"], "left").join(beside(-1, "above"), ["block", "class"], "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own, numbers = F.col("part"), lambda n: F.sequence(F.lit(0), n - 1)
    tile = lambda cls, p, q, side: F.struct(cls.alias("class"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))
    same = F.transform(numbers(F.col("parts")), lambda q: tile(F.col("class") * 2, F.least(q, own), F.greatest(q, own), q < own))
    down = F.transform(numbers(F.col("below")), lambda q: tile(F.col("class") * 2 - 1, q, own, F.lit(1)))
    up = F.transform(numbers(F.col("above")), lambda q: tile(F.col("class") * 2 + 1, own, q, F.lit(0)))
    none = F.array().cast("array<struct<class:int,p:int,q:int,side:int>>")
    sent = dealt.select("block", "id", "text", F.inline(F.concat(same, F.coalesce(down, none), F.coalesce(up, none))))

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = _shared_runs(group["id"].to_numpy(), group["text"].to_pylist(), group["side"].to_numpy(), key[1].as_py() % 2 == 0 and key[2] == key[3], least)
        return pa.table([pa.array(x) for x in found], ["a", "b", "shared", "n", "m"])

    pairs = sent.groupBy("block", "class", "p", "q").applyInArrow(meet, "a long, b long, shared long, n long, m long")
    likeness = F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6)
    return pairs.select("a", "b", likeness.alias("likeness")).where(F.col("likeness") >= least)


#: Fields whose dates count (fixed values).
DATE_FIELDS = "date created updated created_at date_added".split()


def document_date(text: Column, path: Column, modified: Column, as_of: Column, head: int = 2000) -> Column:
    """A whole date in a metadata field, else a month there (its first day), else a date in the path, else the file's time.

    Dates lie between 2000 and the day after ``as_of``; the file's time has the lower bound only. A month counts only
    if no field has a whole date at all.
    """
    start = F.left(text, F.lit(head))
    names = "|".join(DATE_FIELDS)
    fits = lambda d: d.isNotNull() & (d >= F.lit("2000-01-01").cast("date")) & (d <= F.date_add(as_of, 1))
    field = rf"(?mi)^[ \t]*(?:{names})[ \t]*:[ \t]*"
    full = F.regexp_extract_all(start, F.lit(field + r"[\"']?(\d{4}-\d{2}-\d{2})(?:[T ][\d:]+)?[\"']?[ \t]*$"), F.lit(1))
    month = F.regexp_extract(start, field + r"[\"']*([0-9]{4}-[0-9]{2})(?!-[0-9]{2})[\"'\s]*$", 1)
    first = lambda found: F.try_element_at(F.filter(F.transform(found, lambda x: F.try_to_date(x, "yyyy-MM-dd")), fits), F.lit(1))
    named, in_path = first(full), first(F.regexp_extract_all(path, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1)))
    of_month = F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    only = lambda d: F.when(fits(d), d)
    time = F.to_date(modified)
    return F.coalesce(named, F.when(F.size(full) == 0, only(of_month)), in_path, F.when(time >= F.lit("2000-01-01").cast("date"), time))


def date_class(value: Column) -> Column:
    """How a date is written: absent, iso, datetime or non_iso."""
    return (
        F.when(value.isNull() | (F.btrim(value) == ""), "absent").when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "iso")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), "datetime").otherwise("non_iso")
    )


def query_window(text: Column, as_of: Column) -> Column:
    """(start, end) of the time that a query names: a date, a month (with a name too), last week or month, yesterday, today."""
    low = F.lower(text)
    day = F.try_to_date(F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    iso_month = F.try_to_date(F.concat(F.regexp_extract(low, r"(\d{4}-\d{2})", 1), F.lit("-01")), "yyyy-MM-dd")
    names = "january february march april may june july august september october november december".split()
    name = F.regexp_extract(low, rf"({'|'.join(names)})\s+\d{{4}}", 1)
    number = F.array_position(F.array(*[F.lit(x) for x in names]), name).cast("int")
    year = F.regexp_extract(low, rf"(?:{'|'.join(names)})\s+(\d{{4}})", 1).try_cast("int")
    named = F.when(name != "", F.make_date(year, number, F.lit(1)))
    month = F.coalesce(iso_month, named)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    week = F.date_sub(F.trunc(as_of, "week"), 7)
    return (
        F.when(day.isNotNull(), span(day, day)).when(month.isNotNull(), span(month, F.last_day(month)))
        .when(low.contains("last week"), span(week, F.date_add(week, 6)))
        .when(low.contains("last month"), span(F.add_months(F.trunc(as_of, "month"), -1), F.last_day(F.add_months(as_of, -1))))
        .when(low.contains("yesterday"), span(F.date_sub(as_of, 1), F.date_sub(as_of, 1))).when(low.contains("today"), span(as_of, as_of))
    )


#: Intents and the patterns that give them, in the order in which they are tried; what none gives is semantic.
INTENT_RULES = [
    ("temporal", r"(?i)\b(?:when|yesterday|today|tomorrow|last (?:week|month|year|quarter|night)|this (?:week|month|year|morning)|recent(?:ly)?|latest|since|timeline"
                 r"|january|february|march|april|june|july|august|september|october|november|december|\d{4}-\d{2}(?:-\d{2})?)\b"),
    ("multi_hop", r"(?i)\b(?:how (?:does|do|did|is|are) .+ (?:relate|connect|compare|affect|impact|interact)|relationship between|connection between|compare|compared (?:to|with)|difference between|versus|vs\.?)(?:\b|\s|$)"),
    ("entity", r"(?i)\b(?:who(?:'s| is| are| was)|tell me about|about (?:the )?(?:company|person|team|client)|contact (?:for|at)|what (?:do we|do you|does .+) know about)\b|^(?:what is|what's) [A-Z][\w-]+\??$"),
    ("procedural", r"(?i)\b(?:how (?:to|do i|do we|should i|should we|can i|can we)|steps? (?:to|for)|procedure|process for|runbook|playbook|guide (?:to|for)|set ?up|install|configure|deploy)\b"),
    ("keyword", r"^[A-Za-z0-9_.\-/]+(?:\s+[A-Za-z0-9_.\-/]+){0,1}$|\"[^\"]+\"|[A-Za-z0-9]+_[A-Za-z0-9_]+|\b[A-Z]{2,}-\d+\b"),
]


def intent(text: Column) -> Column:
    """The class of a query, by the first rule that fits; never null."""
    found = F.when(text.isNull() | (F.btrim(text) == ""), "semantic")
    for name, pattern in INTENT_RULES:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise("semantic")


#: Classes of notes and their patterns, in the order in which they are tried (fixed values).
NOTE_RULES = [
    ("episodic", r"(?m)^\s*##\s+\d{2}:\d{2}"),
    ("procedural-pattern", r"(?im)^\s*pattern\s*:|^\s*workflow\s*:"),
    ("procedural-rule", r"(?i)\bnever\s+|\balways\s+|\brule\s*:|\bconstraint\s*:|\bnever\s+do\b"),
    ("procedural-pattern", r"(?im)\bhow\s+to\b|^##\s+steps\b|\bstep\s+1\b"),
    ("semantic-decision", r"(?i)\bdecided\s*:|\bdecision\s*:|\bADR-\d+|\bwe\s+chose\b|\bwe\s+decided\b|\brationale\s*:"),
    ("semantic-fact", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|(?i:\bendpoint\s*:|\bversion\s*:|\bvCPU\b|\bport\s+\d{2,5}\b)|:\d{4,5}\b"),
]
#: The file of each class that has one (fixed values).
NOTE_FILES = {"procedural-rule": "rules.md", "procedural-pattern": "patterns.md", "semantic-decision": "decisions.md", "semantic-fact": "facts.md"}


def note_target(agent: Column, kind: Column, day: Column) -> Column:
    """Where a note of this class goes: a day's log of the agent, else a file of its knowledge; null for other classes."""
    log_agent = F.when(agent == "shared", "builder").otherwise(agent)
    files = F.create_map(*[F.lit(x) for pair in NOTE_FILES.items() for x in pair])
    return F.when(kind == "episodic", F.concat_ws("/", log_agent, F.lit("memory"), F.concat(day.cast("string"), F.lit(".md")))).otherwise(
        F.concat(F.lit("knowledge/"), agent, F.lit("/"), files[kind]))


def note_class(text: Column) -> Column:
    """(kind, confidence, reason): the first rule that fits at 0.9, else ``unknown`` at 0, which asks for a second look."""
    found = None
    for name, pattern in NOTE_RULES:
        hit = F.struct(F.lit(name).alias("kind"), F.lit(0.9).alias("confidence"), F.regexp_extract(text, f"({pattern})", 1).alias("reason"))
        found = F.when(text.rlike(pattern), hit) if found is None else found.when(text.rlike(pattern), hit)
    return found.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit(0.0).alias("confidence"), F.lit("").alias("reason")))


def fill_forward(rows: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """``value`` with the last one that isn't null carried on."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def sections(rows: DataFrame, marker: Column, order: str, by: str) -> DataFrame:
    """``section``: the number of marker rows so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(marker.cast("long")).over(w))


def keep_last(rows: DataFrame, n: int, order: str, by: str, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def overlapping_paths(given: DataFrame) -> DataFrame:
    """(name, path, other_name, other_path, kind): owners of one path (``duplicates``, the smaller name as the other), and of a path inside another's (``overlaps``).

    ``given`` is (name, path), a name once; slashes at the end don't count, empty and null paths are none. Each path meets those above
    it by equality, a row for each of its parts, so no pair of paths is compared that doesn't overlap. A name's path held twice is one.
    """
    bare = given.select("name", "path", F.rtrim("path", F.lit("/")).alias("_bare")).where("_bare <> ''").distinct()
    parts = F.split("_bare", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inner = bare.select("name", "path", F.col("_bare").alias("_own"), F.explode(F.array_distinct(above)).alias("_bare"))
    outer = bare.select(F.col("name").alias("other_name"), F.col("path").alias("other_path"), "_bare")
    met = inner.join(outer, "_bare")
    same = F.col("_own") == F.col("_bare")
    kept = met.where((~same & (F.col("name") != F.col("other_name"))) | (same & (F.col("other_name") < F.col("name"))))
    return kept.select("name", "path", "other_name", "other_path", F.when(same, "duplicates").otherwise("overlaps").alias("kind"))


def active_texts(documents: DataFrame, contents: DataFrame) -> DataFrame:
    """(doc_id, path, collection, text) of active ``documents`` whose hash ``contents`` (hash, text) has; a content may serve many documents."""
    live = documents.where(F.col("active") == 1).select("doc_id", "path", "collection", "hash")
    return live.join(contents.groupBy("hash").agg(F.min("text").alias("text")), "hash").select("doc_id", "path", "collection", "text")
