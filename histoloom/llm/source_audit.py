"""How far the sources of a language stand apart: smoothed term shares of every (lang, source), by pairs and by terms.

Documents of one lang and one text are collapsed: copies are counted by source (digests only), one text of each is
tokenised once, in a task, and its term counts and document frequencies enter every source that holds it, weighted by its
copies. From there on only sums by (lang, source, term) move.

Pairs are evaluated sparsely. A source lacks most terms, and all that it lacks have the same share. With P and Q the terms
that two sources have, V all kept terms and p0, q0 the shares of what they lack, the sum of |p - q| over V is

    sum over P of |p - q0|  +  sum over Q of |q - p0|  +  (V - |P| - |Q|) |p0 - q0|
    + sum over terms in both of |p - q| - |p - q0| - |q - p0| + |p0 - q0|

The first two come from how often each count occurs in a source, only the last one needs a join by term.

Defined cases: null text, lang and source count as empty strings; groups without (kept) terms take part with counts of 0;
without any kept term in a lang its pairs have value 0, ranked by name, and there are no term rows; repeated rows are
further documents; texts of any length are read whole; ties go by the items' bytes; an empty table gives no rows; other
columns, whatever their names, are ignored. Counts and values are whole numbers, divisions are exact at any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm.workers import tidied
from histoloom.session import stage

#: Shares are counted in parts of this; every term gets this much besides its count.
PARTS, SMOOTHING = 1_000_000_000, 5
#: Different (lang, source, term) that a task adds up before it sends them on.
KEPT_TERMS = 200_000
#: Kept terms up to which they are broadcast; beyond it the join shuffles.
BROADCAST_TERMS = 500_000
#: Bytes of a text by what they are to terms: letters and all of other characters stay, A-Z in lower case; the rest ends a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[str]:
    """The terms of a text: runs of letters and non-ASCII characters, A-Z in lower case."""
    return [t.decode() for t in text.encode().translate(_LETTERS).split()]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group, each different text of a lang tokenised once."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    rows = rows.select("lang", "source", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    key = ["lang", "d1", "d2"]
    copies = rows.groupBy(*key, "source").agg(F.count("*").alias("copies")).groupBy(*key).agg(F.collect_list(F.struct("source", "copies")).alias("held"))
    distinct = rows.groupBy(*key).agg(F.first("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            langs, sources, words, n, seen = [], [], [], [], []
            for (lang, source), own in sums.items():
                langs += [lang] * len(own)
                sources += [source] * len(own)
                words += own
                n += [x[0] for x in own.values()]
                seen += [x[1] for x in own.values()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, text, held in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("held").to_pylist()):
                found = Counter(text.as_py().encode().translate(_LETTERS).split())
                for copy in held:
                    own, times = sums.setdefault((lang, copy["source"]), {}), copy["copies"]
                    size -= len(own)
                    for term, n in found.items():
                        if (sum_ := own.get(term)) is None:
                            own[term] = [n * times, times]
                        else:
                            sum_[0] += n * times
                            sum_[1] += times
                    size += len(own)
                    if size > KEPT_TERMS:
                        yield out()
                        size = 0
        if sums:
            yield out()

    sent = distinct.join(copies, key).select("lang", "text", "held").mapInArrow(tidied(counted), "lang string, source string, term string, n long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(PARTS * (count + SMOOTHING) / (total + SMOOTHING * kept)), in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    count = F.lit(count) if isinstance(count, int) else F.col(count) if isinstance(count, str) else count
    top = whole(count + SMOOTHING) * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", top, whole(F.col(total) + SMOOTHING * F.col(kept))) + 1


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group: all other sources of its lang by the summed difference of shares, and its `top` terms over the lang's share."""
    counts = stage(term_counts(docs), "term-counts")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    few = kept.count() <= BROADCAST_TERMS
    rows = stage(counts.select("lang", "source", "term", "n").join(F.broadcast(kept) if few else kept, ["lang", "term"]), "kept-counts")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_group = rows.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *map(zero, ("kept", "lang_total", "held", "total")))
    groups = stage(groups.withColumn("absent", F.when(F.col("kept") > 0, _share(0, "total", "kept"))), "groups")

    shares = rows.join(groups.select("lang", "source", "kept", "lang_total", "total", "absent"), ["lang", "source"])
    shares = shares.select("lang", "source", "term", "n", "absent", _share("n", "total", "kept").alias("p"), _share("lang_n", "lang_total", "kept").alias("q"))
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    side = lambda k: shares.select("lang", "term", *[F.col(c).alias(f"{c}{k}") for c in ("source", "p", "absent")])
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = side(1).join(side(2), ["lang", "term"]).where("source1 < source2")
    mended = apart("p1", "p2") - apart("p1", "absent2") - apart("p2", "absent1") + apart("absent1", "absent2")
    both = both.groupBy("lang", "source1", "source2").agg(F.sum(mended).alias("shared"))
    both = both.select("lang", F.col("source1").alias("source"), F.col("source2").alias("item"), "shared").union(both.select("lang", "source2", "source1", "shared"))

    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("q0"), F.col("held").alias("other_held"))
    pairs = groups.select("lang", "source", "kept", "held", F.col("absent").alias("p0")).join(others, "lang").where(F.col("source") != F.col("item"))
    by_count = shares.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("p").alias("p"))  # p follows from n
    alone = by_count.join(others, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(apart("p", "q0") * F.col("times")).alias("alone"))
    of_other = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("other_alone"))
    pairs = pairs.join(alone, ["lang", "source", "item"], "left").join(of_other, ["lang", "source", "item"], "left").join(both, ["lang", "source", "item"], "left")
    nought = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    lacking = nought((F.col("kept") - F.col("held") - F.col("other_held")) * apart("p0", "q0"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (nought("alone") + nought("other_alone") + lacking + nought("shared")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(over).where(F.col("rank") <= top))
