"""Substring deduplication behind a count-min prefilter.

A window is 50 consecutive words; each word covered by a window that also
starts in a document with a smaller id goes. Windows are judged on the input.

1. Sketch. Each window is counted under the smallest hash among its 8-word
   runs, once per document. Equal windows have equal keys, so the merged
   partition sketches overestimate the number of documents that hold a window
   and never underestimate it; neighbouring windows share keys, so about one
   key in twenty words is counted. The sketch has a fixed size: with very much
   data it lets more windows through, which costs time, never a result.
2. Exact grouping of the windows estimated repeated. Neighbouring windows with
   one key are a run. Equal runs are grouped first (copies collapse there);
   where one key has different runs, their windows are grouped one by one.
   Either way a group keeps the smallest id, by partial aggregation.
3. Each run learns which of its windows are covered; a document's covered
   spans meet its text and the words that stay are joined.

Groups are compared by 64-bit key and 64-bit hash of the whole window. Hot
passages: aggregations combine in each task, joins to runs are split by AQE.

Null text has no words. Rows without id count as the largest id: they lose
words to others, and none to each other. Rows with equal ids do not cover each
other. Repeated rows are returned each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm import hashing
from stocklens.session import materialize

WINDOW = 50
GRAM = 8
RUN = 64  # windows in a run at most
_LAST = (1 << 63) - 1
_RUN_KEY = ["mini", "fp", "n"]


def _keys(words: np.ndarray) -> np.ndarray:
    """Key of each window."""
    return hashing.sliding_min(hashing.run_hashes(words, GRAM), WINDOW - GRAM + 1)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column)


def _window_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in _texts(batch.column(0)):
        words = text.split()
        if len(words) >= WINDOW:
            yield np.unique(_keys(hashing.word_hashes(words)))


def _runs_of(words: np.ndarray, sketch: np.ndarray) -> Iterator[tuple]:
    """(key, fingerprint, windows, first window, window hashes) of runs that may be repeated."""
    keys = _keys(words)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    kept = hashing.maybe_twice(sketch, keys[starts])
    if not kept.any():
        return
    ends = np.append(starts[1:], len(keys))
    windows = hashing.run_hashes(words, WINDOW)
    for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True):
        for s in range(a, b, RUN):
            own = windows[s : min(s + RUN, b)].astype(np.int64)
            fp = hashing.xxhash.xxh3_64_intdigest(own.tobytes())
            yield int(keys[a].astype(np.int64)), fp - (1 << 63), len(own), s, own


def _runs(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, doc, key in zip(_texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                if len(words) >= WINDOW:
                    out += [(doc, key, *r) for r in _runs_of(hashing.word_hashes(words), sketch)]
            if out:
                doc, key, mini, fp, n, start, windows = zip(*out, strict=True)
                flat = pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), pa.array(np.concatenate(windows)))
                columns = [pa.array(x, pa.int64()) for x in (doc, key, mini, fp)] + [pa.array(n, pa.int32()), pa.array(start, pa.int32()), flat]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "mini", "fp", "n", "start", "windows"])

    return docs.select("text", "doc", "key").mapInArrow(run, "doc long, key long, mini long, fp long, n int, start int, windows array<long>")


def _covered(runs: DataFrame) -> DataFrame:
    """doc, key, spans: the word spans (first, past the last) of each document that go."""
    kinds = runs.groupBy(*_RUN_KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    kinds = materialize(kinds, "substring-kinds")
    mixed = kinds.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("mini")
    # one holder of each kind of run whose key has other kinds: the smallest id
    holders = runs.join(kinds.join(mixed, "mini"), _RUN_KEY).filter("doc = first").dropDuplicates(_RUN_KEY)
    windows = holders.select(*_RUN_KEY, "first", F.posexplode("windows").alias("at", "window"))
    windows = materialize(windows, "substring-windows")
    least = windows.groupBy("mini", "window").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").drop("most")
    own = windows.join(least, ["mini", "window"]).filter("least < first").groupBy(*_RUN_KEY).agg(F.collect_set("at").alias("own"))
    found = kinds.join(own, _RUN_KEY, "left").filter("first < last or own is not null").select(*_RUN_KEY, "first", "own")
    found = materialize(found, "substring-found")  # so that the next join shuffles both sides, and a hot run can be split
    # rows that repeat have the same runs: each is met once
    hits = runs.select("doc", "key", "start", *_RUN_KEY).distinct().join(found, _RUN_KEY)
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + WINDOW).alias("b")))
    each = F.transform(F.col("own"), lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + WINDOW).alias("b")))
    spans = F.when(F.col("doc") > F.col("first"), whole).otherwise(each)
    return hits.select("doc", "key", spans.alias("spans")).filter("spans is not null").groupBy("doc", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _stay(docs: DataFrame, covered: DataFrame, *, with_text: bool) -> DataFrame:
    """Words, words that go, and the text or the digest of those that stay."""
    joined = docs.join(covered.withColumnsRenamed({"doc": "d", "key": "k"}), (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    joined = joined.select("text", "doc_id", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, out = [], [], []
            for text, a, b in zip(_texts(batch.column(0)), batch.column(2), batch.column(3), strict=True):
                words = text.split()
                kept = words
                if a.is_valid:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.asarray(a.values), 1)
                    np.add.at(change, np.asarray(b.values), -1)
                    cover = np.cumsum(change[:-1]) > 0
                    kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
                joined_words = b" ".join(kept)
                out.append(joined_words.decode() if with_text else hashlib.sha256(joined_words).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"]
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, *, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text that stays, or its SHA-256) of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)), "key": F.xxhash64("text")})
    sketch = hashing.seen_twice(docs.select("text"), _window_keys)
    runs = materialize(_runs(d, sketch), "substring-runs")
    return _stay(d, _covered(runs), with_text=with_text)


def query(docs: DataFrame) -> DataFrame:
    """op3: figures and digest of what stays of every document."""
    return remove_repeats(docs, with_text=False).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
     k AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM s),
     m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM k),
     c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM m WHERE least < doc_id),
     g AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
     x AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
     y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos
           WHERE c.pos IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN y ON d.doc_id = y.doc_id
"""
