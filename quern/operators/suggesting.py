"""Names that texts suggest, how well candidates fit them, memory logs by their files' names, and summaries by a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import first_words, token_estimate
from quern.operators.graph import suggestions

_CAPITAL = r"\p{Lu}[\p{L}\p{N}&.'’-]*[\p{L}\p{N}]"
#: Runs of words with capitals: with a company's ending, of several words, and of capitals alone; a single capitalised word may only begin a sentence.
NAMED = [
    ("ORG", rf"\b{_CAPITAL}(?:\s{_CAPITAL})*\s(?:Inc|Ltd|LLC|GmbH|Corp|Corporation|Company|Group|Partners|Bank|University|Institute|Foundation)\b"),
    ("PERSON", rf"\b{_CAPITAL}(?:\s{_CAPITAL}){{1,3}}\b"), ("ORG", r"\b\p{Lu}{2,}\b"),
]
CONTEXT = 200


def named_things(notes: DataFrame) -> DataFrame:
    """(doc_id, surface, label, text): each name in ``notes`` (doc_id, text) once, with the first sentence that has it, cut to 200 characters.

    A rule for runs without a model: the first pattern that finds a name at a place gives its label. Notes with a null text have none.
    """
    sentences = notes.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("_at", "_s"))
    every = "|".join(f"(?:{p})" for _, p in NAMED)
    each = sentences.select("doc_id", "_at", "_s", F.posexplode(F.regexp_extract_all("_s", F.lit(every), F.lit(0))).alias("_k", "surface"))
    label = F.lit(None).cast("string")
    for kind, pattern in reversed(NAMED):
        label = F.when(F.rlike("surface", F.lit(f"^(?:{pattern})$")), kind).otherwise(label)
    return each.groupBy("doc_id", "surface").agg(F.min_by(F.struct(F.left(F.btrim("_s"), F.lit(CONTEXT)).alias("text")), F.struct("_at", "_k")).alias("_c")).select("doc_id", "surface", label.alias("label"), "_c.text")


def suggested(notes: DataFrame, nodes: DataFrame, allowed: DataFrame, roles: Sequence[str], found: DataFrame | None = None) -> DataFrame:
    """(doc_id, surface, label, source, context, existing_id, is_new): names of ``notes`` after the filters, and the node (id, name) that each is.

    ``found`` is what a recogniser says (doc_id, surface, label, text), by default :func:`named_things`. Of nodes with one name the smallest id counts.
    """
    found = named_things(notes) if found is None else found
    kept = suggestions(found, allowed, roles).dropDuplicates(["doc_id", "surface"])
    known = nodes.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("existing_id"))
    shown = kept.join(found.groupBy("doc_id", "surface").agg(F.min("text").alias("context")), ["doc_id", "surface"])
    return shown.join(known, F.lower("surface") == F.col("_name"), "left").select("doc_id", "surface", "label", "source", "context", "existing_id", F.col("existing_id").isNull().alias("is_new"))


def match_grade(name: Column, label: Column) -> Column:
    """How well a candidate's label fits a name: ``high`` if they are equal in any case, ``medium`` if one holds the other, else ``low``; nulls are empty."""
    a, b = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, label))
    return F.when(a == b, "high").when(F.contains(b, a) | F.contains(a, b), "medium").otherwise("low")


def memory_logs(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, …) whose file is named by a day, with ``day``; a name like 2026-13-40 is no day."""
    day = F.try_to_date(F.regexp_extract(F.substring_index("path", "/", -1), r"^(\d{4}-\d{2}-\d{2})\.md$", 1), "yyyy-MM-dd")
    return files.withColumn("day", day).where("day IS NOT NULL")


def summaries(documents: DataFrame, provider: Callable[[str, str, int], str], levels: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(path, level, summary, tokens, failed) of ``documents`` (path, text): what the provider makes of a path, a text's first words and a bound of tokens.

    ``levels`` are the words given and the tokens asked for: L0 800 and 150, L1 2000 and 600. A document at which the provider fails has no summary and
    doesn't stop the others; documents without words are not asked for.
    """
    levels = levels or {"L0": (800, 150), "L1": (2000, 600)}
    given = F.array(*[F.struct(F.lit(k).alias("level"), first_words(F.col("text"), n).alias("given"), F.lit(t).alias("bound")) for k, (n, t) in levels.items()])
    asked = documents.select("path", F.inline(given)).where("given <> ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.itertuples():
                try:
                    made.append(provider(row.path, row.given, row.bound))
                except Exception:  # a provider may raise anything
                    made.append(None)
            yield frame[["path", "level"]].assign(summary=made)

    done = asked.mapInPandas(run, "path string, level string, summary string")
    return done.select("path", "level", "summary", token_estimate(F.col("summary")).alias("tokens"), F.col("summary").isNull().alias("failed"))
