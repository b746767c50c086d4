"""Stupid-backoff scores of whole documents against counts over the whole corpus.

Texts become n-gram rows: a word's full n-gram is its history (the words before it) and the word. The rows are dealt by a hash
of the history, packed as arrays with the other n-grams of one bucket until they have been exchanged, then exploded. So a
bucket's count tables, of n-grams and of histories, are complete; they are joined to the exploded n-grams within the bucket
without another exchange, and the logarithms are summed for each document.

With all counts kept, every n-gram of a document is known, so a document of n words scores
    log c(first full n-gram) - log N + sum over the later ones of (log c(n-gram) - log c(history)):
the scores of its first words, with their shorter histories, telescope. Rows of shorter n-grams are needed only for documents
shorter than a history. With least > 1 shorter n-grams decide word by word, so rows of every length are joined.

Histories that hold more than a quarter of a partition's fair share in a sample are dealt over all buckets instead. Their counts
are made with partial sums before the exchange, and joined as any large table is. The sample only decides the route."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, staged, table

GROUP = 200
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) one after the other, and each text's number of words."""
    parts, n = [], []
    for at in range(0, len(texts), GROUP):
        words: list[bytes] = []
        for t in texts[at : at + GROUP]:
            own = t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else []
            words += own
            n.append(len(own))
        if words:
            parts.append(pd.util.hash_array(np.array(words, object), categorize=False))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(n, np.int64)


def ngrams(h: np.ndarray, n: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1..order: the hashes of the n-grams that end at each word, and whether the word's text reaches back so far."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    out = [(stir(h), np.ones(len(h), bool))]
    for k in range(1, order):
        key = np.concatenate([np.zeros(1, np.uint64), out[-1][0][:-1]]) if len(h) else out[-1][0]
        key = stir(key * FACTOR + h + np.uint64(k))
        out.append((key, place >= k))
    return out


#: What a packed row holds: DOC (doc: row, gram: doc_id), SIZE (gram: words), GRAMS (doc: row and code), SHORT (a text shorter than a
#: history), COUNT (doc: how often gram is there, an n-gram shorter than a history).
DOC, SIZE, GRAMS, SHORT, COUNT = range(5)
#: Code of an entry of GRAMS, in the last three bits of doc, where no condition on it can be pushed below the exchange: a full n-gram
#: after another one, a text's first, END (a text's last words, a history that nothing follows), WHOLE (a text that is just a
#: history). With HOT, tail tells the hot history and gram the word.
LATER, FIRST, END, WHOLE, HOT = range(5)
#: bucket and kind are never null: conditions on that would be pushed below the exchange, which then could not be shared.
PACKED = T.StructType([T.StructField("bucket", T.IntegerType(), False), T.StructField("kind", T.IntegerType(), False), *[T.StructField(n, T.ArrayType(t), False) for n, t in (("doc", T.LongType()), ("gram", T.LongType()), ("tail", T.ShortType()))]])
CHARS = 4_000_000


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """doc_ids and texts, some millions of characters at a time."""
    names, texts, size = [], [], 0
    for b in batches:
        for name, text in zip(b["doc_id"], b["text"]):
            names.append(name.as_py())
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= CHARS:
                yield names, texts
                names, texts, size = [], [], 0
    if names:
        yield names, texts


def histories(h: np.ndarray, n: np.ndarray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The n-grams up to a history's length, each full n-gram's last word, and its history; of order 1 the word is its own history."""
    grams = ngrams(h, n, max(1, order - 1))
    if order == 1:
        return grams, np.arange(len(h)), grams[0][0]
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    full = np.flatnonzero(place >= order - 1)
    return grams, full, grams[-1][0][full - 1]


def hot_histories(docs: DataFrame, order: int, every: int, parts: int) -> np.ndarray:
    """Sorted hashes of the histories with more than 1 / (4 parts) of the full n-grams in about one of `every` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in groups(batches):
            p, c = np.unique(histories(*word_hashes(texts), order)[2].view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(p), pa.array(c)], names=["p", "c"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "p bigint, c bigint").groupBy("p").agg(F.sum("c").alias("c"))
    counts = staged(counts, "lm-sample")
    of = counts.agg(F.sum("c")).first()[0] or 0
    top = counts.filter(F.col("c") * 4 * parts > of).orderBy(F.desc("c"), "p").limit(1 << 14).select("p").collect()  # at most 4 a partition
    return np.sort(np.array([r.p for r in top], np.int64).view(np.uint64))


def packed_rows(docs: DataFrame, order: int, labels_: np.ndarray, hot: np.ndarray) -> DataFrame:
    """The n-grams of all texts, as PACKED and its kinds tell; 48 bits of the history and 32 of the word tell n-grams of a bucket
    apart. labels_: the number of each bucket."""
    buckets = len(labels_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        row, waiting = part << 36, [np.empty(0, np.uint64), np.empty(0, np.int64)]

        def batch(parts: list) -> pa.RecordBatch:
            """parts: bucket, kind, doc, gram, tail, as arrays; doc_ids, which may be null, have a mask in place of the tail."""
            bucket, kind = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            doc, gram, tail = (np.concatenate([np.asarray(p[i]).astype(np.int64) for p in parts]) for i in (2, 3, 4))
            key = bucket.astype(np.int64) * 8 + kind
            order_ = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.diff(key[order_], prepend=-1))
            offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
            labels = labels_[bucket[order_[begin]].astype(np.int64)]
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(doc[order_]), pa.array(gram[order_], mask=(kind == DOC)[order_] & (tail[order_] != 0)), pa.array(tail[order_].astype(np.int16)))]
            first = order_[begin]
            return pa.record_batch([pa.array(labels), pa.array(kind[first].astype(np.int32)), *lists], names=["bucket", "kind", "doc", "gram", "tail"])

        def of(code, p, doc, w=None):
            """Entries of histories p and words w; w is None where nothing follows."""
            p, code = np.asarray(p, np.uint64), np.full(len(p), code) if np.isscalar(code) else code
            word = np.zeros(len(p), np.uint64) if w is None else w & np.uint64(0xFFFFFFFF)
            bucket = ((p >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            gram = (p << np.uint64(16)) | (word >> np.uint64(16))
            tail = word & np.uint64(0xFFFF)
            if len(hot):
                at = np.searchsorted(hot, p).clip(max=len(hot) - 1)
                is_hot = hot[at] == p
                bucket, code = np.where(is_hot, doc.astype(np.uint64) % np.uint64(buckets), bucket), np.where(is_hot, HOT + code, code)
                gram, tail = np.where(is_hot, 0 if w is None else w, gram), np.where(is_hot, at.astype(np.uint64), tail)
            return bucket, np.full(len(p), GRAMS), doc * 8 + code, gram.view(np.int64), tail.astype(np.uint16).view(np.int16)

        def small(kind, gram, doc):
            """Entries of whole hashes."""
            bucket = ((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            return bucket, np.full(len(gram), kind), doc, gram.view(np.int64), np.zeros(len(gram), np.int16)

        def counted(most: int) -> list:
            """The counts that wait, summed up, unless they are few."""
            keys, inverse = np.unique(waiting[0], return_inverse=True)
            waiting[:] = keys, np.bincount(inverse, waiting[1], len(keys)).astype(np.int64)
            if len(keys) <= most:
                return []
            out = small(COUNT, *waiting)
            waiting[:] = np.empty(0, np.uint64), np.empty(0, np.int64)
            return [out]

        for names, texts in groups(batches):
            h, n = word_hashes(texts)
            grams, full, p = histories(h, n, order)
            owner, last = np.repeat(np.arange(len(n)), n), np.cumsum(n) - 1
            rows = row + np.arange(len(n))
            row += len(n)
            spread = np.full(len(n), (part + row) % buckets, np.uint64)  # one packed row
            none = np.array([x is None for x in names])
            parts = [(spread, np.full(len(n), DOC), rows, np.array([x or 0 for x in names], np.int64), none), (spread, np.full(len(n), SIZE), rows, n, np.zeros(len(n)))]
            if order == 1:
                parts.append(of(FIRST, p, rows[owner]))
            else:
                first = np.diff(owner[full], prepend=-1) != 0
                parts.append(of(np.where(first, FIRST, LATER), p, rows[owner[full]], h[full]))
                ended = np.flatnonzero(n >= order - 1)
                parts.append(of(np.where(n[ended] == order - 1, WHOLE, END), grams[-1][0][last[ended]], rows[ended]))
                for k, (key, valid) in enumerate(grams[:-1]):
                    short = np.flatnonzero(n == k + 1)
                    parts.append(small(SHORT, key[last[short]], rows[short]))
                    keys, counts = np.unique(key[valid], return_counts=True)
                    waiting = [np.concatenate([waiting[0], keys]), np.concatenate([waiting[1], counts])]
                if len(waiting[0]) > 4_000_000:
                    parts += counted(2_000_000)
            yield batch(parts)
        if rest := counted(0):
            yield batch(rest)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def bucket_labels(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of `parts` partitions the smallest number that Spark's hash deals to it, so that buckets are dealt evenly, one each."""
    to = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = {r.t: r.label for r in spark.range(64 * parts).groupBy(to.alias("t")).agg(F.min("id").alias("label")).collect()}
    return np.array([found.get(t, 64 * parts + t) for t in range(parts)], np.int32)


def known_scores(docs: DataFrame, order: int, sample_every: int) -> DataFrame:
    """row, doc_id, n_words and the sum of the logarithms, without those of the number of all words."""
    spark, parts = docs.sparkSession, 2 * partitions(docs.sparkSession)  # a partition's tables and rows are sorted in memory
    packed = packed_rows(docs, order, bucket_labels(spark, parts), hot_histories(docs, order, sample_every, parts)).repartition(parts, "bucket")

    def entries(kind: int) -> DataFrame:
        """The rows of a kind; chosen where they are exploded, so that all read the one exchange."""
        rows = packed.select("bucket", F.inline_outer(F.when(F.col("kind") == kind, F.arrays_zip("doc", "gram", "tail"))))
        return rows.filter("doc is not null")

    def scored(rows: DataFrame, gram: list[str], history: list[str], hot: bool) -> DataFrame:
        counts = rows.groupBy(*dict.fromkeys([*history, *gram])).agg(F.count(F.lit(1)).alias("c"))
        if hot:
            few = counts.groupBy(*history).agg(F.sum("c").alias("h"))  # a row a hot history, at most 4 a partition
            counts = counts.join(F.broadcast(few), history)
        else:
            counts = counts.withColumn("h", F.sum("c").over(W.partitionBy(*history)))
        joined = rows.join(counts.select(*gram, "c", "h").hint("merge"), gram)  # both sides grow with the corpus: never broadcast
        value = F.when(F.col("code") == LATER, F.ln("c") - F.ln("h")).when(F.col("code") == FIRST, F.ln("c")).when(F.col("code") == WHOLE, F.ln("h")).otherwise(0.0)
        return joined.select("doc", value.alias("value"))

    code = F.col("doc").bitwiseAND(3).cast("int")
    # an n-gram's last bits, and whether nothing follows the history
    last = F.col("tail").cast("int") * 2 + code.isin(END, WHOLE).cast("int")
    rows = entries(GRAMS).select("bucket", F.shiftright("doc", 3).alias("doc"), code.alias("code"), "gram", "tail", last.alias("last"), (F.col("doc").bitwiseAND(HOT) != 0).alias("hot"))
    plain = rows.filter("not hot").select("bucket", "doc", "code", "gram", "last", F.shiftrightunsigned("gram", 16).alias("p"))
    hot = rows.filter("hot").select("doc", "code", "gram", "tail", "last")
    totals = entries(COUNT).groupBy("gram", "bucket").agg(F.sum("doc").alias("c"))
    short = entries(SHORT).join(totals, ["gram", "bucket"]).select("doc", F.ln("c").alias("value"))
    values = scored(plain, ["gram", "last", "bucket"], ["p", "bucket"], False).unionByName(scored(hot, ["gram", "last"], ["tail"], True)).unionByName(short)
    null = F.lit(None).cast("long")
    whole = entries(DOC).select("doc", F.col("gram").alias("doc_id"), null.alias("n_words"), F.lit(0.0).alias("value"))
    whole = whole.unionByName(entries(SIZE).select("doc", null.alias("doc_id"), F.col("gram").alias("n_words"), F.lit(0.0).alias("value")))
    whole = whole.unionByName(values.select("doc", null.alias("doc_id"), null.alias("n_words"), "value"))
    sums = whole.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("value").alias("value"))
    # a bucket's tables and rows lie together already; without this setting Spark would deal both anew by all keys of the join
    key, before = "spark.sql.requireAllClusterKeysForCoPartition", spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set(key, "false")
    try:
        return staged(sums, "lm-sums")
    finally:
        spark.conf.set(key, before)


def word_scores(docs: DataFrame, order: int, least: int, backoff: float) -> DataFrame:
    """row, doc_id, n_words, n_backed_off and the sum of the logarithms, word by word from n-grams of every length up to order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for names, texts in groups(batches):
            h, n = word_hashes(texts)
            grams, rows = ngrams(h, n, order), row + np.arange(len(n))
            row += len(n)
            yield pa.record_batch([pa.array(rows), pa.array(names, pa.int64()), pa.array(n), *[pa.nulls(len(n), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]], names=columns)
            for k, (key, valid) in enumerate(grams):
                at = np.flatnonzero(valid)
                history = grams[k - 1][0][at - 1] if k else np.zeros(len(at), np.uint64)
                yield pa.record_batch([pa.array(np.repeat(rows, n)[at]), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(at), pa.array(np.full(len(at), k, np.int32)), pa.array(key[at].view(np.int64)), pa.array(history.view(np.int64))], names=columns)

    columns = ["row", "doc_id", "n_words", "place", "k", "gram", "history"]
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, place bigint, k int, gram bigint, history bigint"), "lm-rows")
    grams = rows.filter("place is not null")
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    every = grams.filter("k = 0").groupBy("gram").agg(F.count(F.lit(1)).alias("c"))
    known = grams.filter("k > 0").join(counts, "gram").join(counts.toDF("history", "h"), "history").select("row", "place", "k", F.ln(F.col("c") / F.col("h")).alias("value"))
    known = known.unionByName(grams.filter("k = 0").join(every, "gram").select("row", "place", "k", F.ln("c").alias("value")))
    reach = grams.groupBy("row", "place").agg(F.max("k").alias("reach"))
    words = known.groupBy("row", "place").agg(F.max_by("value", "k").alias("value"), F.max("k").alias("k")).join(reach, ["row", "place"])
    words = words.select("row", "k", (F.col("value") + (F.col("reach") - F.col("k")) * float(np.log(backoff))).alias("value"), (F.col("k") < F.col("reach")).cast("long").alias("backed_off"))
    sums = words.groupBy("row").agg(F.sum("value").alias("value"), F.sum("backed_off").alias("n_backed_off"), F.sum((F.col("k") == 0).cast("long")).alias("alone"))
    return staged(rows.filter("place is null").select("row", "doc_id", "n_words").join(sums, "row", "left"), "lm-sums")


def stupid_backoff(docs: DataFrame, order: int = 3, least: int = 1, backoff: float = 0.4, sample_every: int = 64) -> DataFrame:
    """One row for each document: doc_id, n_words, n_backed_off, log_score (summed over its words), mean_log_score (null without words).

    Words are runs of other characters than white space, A-Z lower-cased. The score of a word after its history is count(n-gram) /
    count(history) for the longest n-gram within the document that the corpus holds at least `least` times, times `backoff` for each
    word dropped; a word alone scores count / all words, whatever its count. Counts are of all documents; with least = 1 nothing backs
    off. A null or empty text has no words and log_score 0. Repeated rows, with an id or without, all count and are scored
    each; an empty table gives no rows; other columns are not read."""
    if least > 1:
        sums = word_scores(docs, order, least, backoff)
        off, alone = F.coalesce("n_backed_off", F.lit(0)), F.coalesce("alone", F.lit(0))
    else:
        sums = known_scores(docs, order, sample_every)
        off, alone = F.lit(0), F.col("n_words") if order == 1 else (F.col("n_words") > 0).cast("long")
    all_words = sums.agg(F.sum("n_words")).first()[0] or 1
    score = F.coalesce(F.col("value"), F.lit(0.0)) - alone * float(np.log(all_words))
    result = sums.select("doc_id", "n_words", off.cast("long").alias("n_backed_off"), score.alias("log_score"))
    return result.select("*", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))
