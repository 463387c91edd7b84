"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of `window` words is named by the least hash of the `gram`-word grams in it, so equal windows have
equal names, and neighbouring windows mostly share theirs: a document has about 2 / (window - gram + 2) names
a word. The names are joined with those of the benchmark's windows; only where a name is found are the
document's windows of that name extended to their full words and compared. Every shared span of `window`
words is found, as its window has the same name on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.llm.shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A benchmark of at most so many distinct windows is broadcast; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _named(rows: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Rows with `_words`, and `_names`: for each length, the name of the window at each start.

    Grams are hashed, and least grams found, by doubling: two neighbouring runs of an array are zipped to one twice as
    long. No lambda reads a column, as Spark may build one anew for every element.
    """
    d = rows.withColumns({"_r1": F.transform("_words", lambda w: F.xxhash64(w)), "_n": F.size("_words")})
    made = {"_r1", "_n"}

    def zipped(name: str, left: str, right: str, ahead: int, width: int, f) -> str:
        """A column of f(left[i], right[i + ahead]) for each start i of a run of `width` words."""
        nonlocal d
        if name not in made:
            n = F.greatest(F.col("_n") - F.lit(width - 1), F.lit(0))
            d = d.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, ahead + 1, n), f))
            made.add(name)
        return name

    def hashed(k: int) -> str:
        if k == 1:
            return "_r1"
        half = 1 << (k - 1).bit_length() - 1
        return zipped(f"_r{k}", hashed(half), hashed(k - half), half, k, lambda x, y: F.xxhash64(x, y))

    def least(k: int, m: int, add: int = 0) -> str:
        """Least of m neighbouring k-grams, and `add`: of the first `part` of them and the last."""
        if m == 1:
            return hashed(k)
        part = 1 << (m - 1).bit_length() - 1
        own = least(k, part)
        return zipped(f"_m{k}_{m}_{add}", own, own, m - part, k + m - 1, lambda x, y: F.least(x, y) + F.lit(add))

    names = []
    for length in lengths:
        k = min(gram, length)
        names.append(F.col(least(k, length - k + 1, length if length > k else 0)))
    return d.withColumn("_names", F.array(*names)).drop(*made)


def _window_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("_words", start + 1, length), " ")


def _benchmark(items: DataFrame, lengths: list[int], gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(name, length) of the benchmark's windows and (win, items), a window's words and the items that hold it."""
    own_names = F.get("_names", F.array_position(F.array(*[F.lit(x) for x in lengths]), F.col("length")).cast("int") - 1)
    own = _named(items, lengths, gram).select("item_id", "_words", "length", F.posexplode_outer(own_names).alias("start", "name"))
    own = written(own.select("item_id", "length", "name", _window_text(F.col("start"), F.col("length")).alias("win")))
    names, wins = own.select("name", "length").distinct(), own.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    if own.limit(most + 1).count() <= most:
        return F.broadcast(names), F.broadcast(wins)
    return names, wins


def _merged(spans: Column) -> Column:
    """Sorted (start, stop) spans, joined where they touch."""
    kind = "array<struct<start:int,stop:int>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["stop"]), joined).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    gram: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, text_hash, n_words, spans array<struct<start, stop>> of hit words, items array<string>) for each document row.

    A benchmark item of fewer than `window` words is one window of its own length. Null and empty texts have
    no words and hit nothing; items without words occur nowhere; a null item id reads as `null`. Null document
    ids are one more id; text_hash, the text's xxhash64, tells rows of one id apart. Repeated rows get a row each, with
    equal results. Without documents there are no rows; without items every document is clean. Other columns are
    ignored. A benchmark of more than `broadcast_windows` distinct windows is joined by shuffle, with equal results.
    """
    no_spans, no_items = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), words_of(F.col(item_text_col)).alias("_words"))
    items = items.where(F.size("_words") > 0).distinct().withColumn("length", F.least(F.size("_words"), F.lit(window)))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # `window` numbers at most
    keys = ["doc_id", "_text"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_text"), F.col(text_col).alias("_raw"))
    worded = rows.select(*keys, words_of(F.col("_raw")).alias("_words"))
    n_words = F.size("_words").cast("long").alias("n_words")
    if not lengths:
        return worded.select("doc_id", F.col("_text").alias("text_hash"), n_words, no_spans.alias("spans"), no_items.alias("items"))
    names, wins = _benchmark(items, lengths, gram, broadcast_windows)

    # One pass over all texts: each row's first entry stands for the row, the others are its names. posexplode_outer,
    # as posexplode would have Spark test the entries' size first, and build them twice for it.
    entries = F.concat(F.array(F.xxhash64(*keys)), F.array_distinct(F.flatten("_names")))
    spread = _named(worded.select(*keys, "_words", n_words), lengths, gram).select(*keys, "n_words", F.posexplode_outer(entries).alias("_at", "name"))
    met = written(spread.join(names, "name", "left").where("_at = 0 or length is not null").select(*keys, "n_words", "_at"))

    # The texts with a name of the benchmark again: their windows of such names are extended to all words, where a
    # name is found only. Beyond the broadcast bound these are sort-merge joins, whose hot names adaptive execution splits.
    some = met.where("_at > 0").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))
    again = written(rows.join(some, same, "left_semi").select(*keys, words_of(F.col("_raw")).alias("_words")))

    def placed(at: int, length: int) -> Column:
        return F.transform(F.get("_names", F.lit(at)), lambda name, i: F.struct(i.alias("start"), F.lit(length).alias("length"), name.alias("name")))

    places = F.flatten(F.array(*[placed(at, length) for at, length in enumerate(lengths)]))
    named = _named(again, lengths, gram).select(*keys, F.explode_outer(places).alias("w")).select(*keys, "w.*").join(names, ["name", "length"])
    starts = named.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t")).agg(F.collect_set(F.struct("start", "length")).alias("_starts"))
    told = again.join(starts, same).select(*keys, "_words", F.explode("_starts").alias("w"))
    hits = told.select(*keys, "w.*", _window_text(F.col("w.start"), F.col("w.length")).alias("win")).join(wins, "win")
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("length")).cast("int").alias("stop"))
    found = hits.groupBy(*keys).agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "spans", "items")
    return met.where("_at = 0").join(found, same, "left").select(
        "doc_id", F.col("_text").alias("text_hash"), "n_words", F.coalesce(_merged(F.col("spans")), no_spans).alias("spans"), F.coalesce("items", no_items).alias("items")
    )


def digests(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i1 AS (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i + 1 : i + l], ' ') AS s FROM i1),
d1 AS (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
hit AS (SELECT r, i, d2.l, item_id FROM (SELECT r, i, l, array_to_string(w[i + 1 : i + l], ' ') AS s FROM d1) d2 JOIN win ON d2.s = win.s AND d2.l = win.l),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
