"""Line dedup by a log-template tree.

A line falls down a tree of fixed depth: by its number of tokens, by its leading tokens (four, or a quarter where that
is more), then by its other tokens, cut into `RUNS` runs of even length. A token with a digit counts as variable
(`<*>`) everywhere; a line of such tokens alone has nothing that shows a template and is taken literally. Variable
fields without digits are found by generalising runs: a line goes down one path for each choice of `free` runs that
are left open, and two lines with a path in common are of one template, as are lines that a chain of such pairs joins.
So lines of a template have equal leading tokens and pairwise steps that differ in at most `free` runs. Lines of fewer
than `SHORT` tokens are templates of their own: nothing of them is generalised but tokens with digits.

A template whose lines stand in more than one document stays in the first of them, and its lines are dropped from all
others. Every line has at most 15 paths, and lines of a path are joined to the least of them by one group-by, so the
work grows with the number of distinct lines, whatever number of lines share a leaf or a path.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterlake.llm.components import connected_components
from platterlake.llm.shared import pieces, texts, written

LEADING, RUNS, FREE, SHORT = 4, 6, 2, 8
VARIABLE = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def _hash(x: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def masked(line: bytes) -> list[bytes]:
    """The line's tokens, those with a digit generalised unless all have one."""
    words = line.split()
    if _DIGIT.search(line):
        shown = [VARIABLE if _DIGIT.search(w) else w for w in words]
        words = shown if any(w is not VARIABLE for w in shown) else words
    return words


def cut_runs(words: list[bytes], leading: int = LEADING) -> tuple[list[bytes], list[list[bytes]]]:
    """The leading tokens, and the runs of the others; no runs where the line is too short to generalise any."""
    if len(words) < SHORT:
        return words, []
    head = max(leading, len(words) // 4)
    rest = words[head:]
    n = min(RUNS, len(rest))
    return words[:head], [rest[len(rest) * k // n : len(rest) * (k + 1) // n] for k in range(n)]


def free_runs(n: int) -> int:
    """How many of a line's n runs may be open: two, fewer where there are few."""
    return min(FREE, n // 3)


def line_name(words: list[bytes]) -> int:
    return _hash(b" ".join(words))


def _paths(leaf: Column, runs: Column) -> Column:
    """One hash for each choice of open runs: of the leaf, the choice and all other runs."""
    found = []
    for n in range(1, RUNS + 1):
        choices = list(itertools.combinations(range(n), free_runs(n)))
        paths = [F.xxhash64(leaf, F.lit(str(c)), *[F.get(runs, F.lit(k)) for k in range(n) if k not in c]) for c in choices if c]
        found.append(F.when(F.size(runs) == n, F.array(*paths) if paths else F.array().cast("array<long>")))
    return F.coalesce(*found, F.array().cast("array<long>"))


def line_templates(lines: DataFrame) -> DataFrame:
    """(line, template) of the distinct lines (line, leaf, runs array<long>) that share a path: the template is named by its least line."""
    path = lines.select("line", F.explode(_paths(F.col("leaf"), F.col("runs"))).alias("path"))
    shared = path.groupBy("path").agg(F.min("line").alias("least"), F.max("line").alias("most")).where("least < most").drop("most")
    joined = path.join(shared, "path").where("line > least").select("line", "least").distinct()
    return connected_components(joined, "line", "least").withColumnsRenamed({"node": "line", "component": "template"})


def drop_recurring_lines(
    docs: DataFrame,
    leading: int = LEADING,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(the columns named in `keep`, doc_id, text without the dropped lines, n_lines, n_parsed, n_dropped) for each row.

    Lines end at line feeds; blank ones are neither parsed nor dropped, all others are parsed (n_parsed). Within one
    document nothing is dropped for recurring. A document is an id and a text: the first is that of least id (null
    last), then of least hash of its text; repeated rows are one document and cut alike. Null text stays null, with
    no lines; an empty one is one blank line. Empty table: no rows. Columns not named are ignored.
    """
    doc = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    rows = docs.select(doc.alias("_doc"), F.col(text_col).alias("_text"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                raw, at = texts(piece, "_text")
                own, name, leaf, runs = [], [], [], []
                for d, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    seen = set()
                    for line in raw[low:high].tobytes().split(b"\n"):
                        words = masked(line)
                        h = line_name(words)
                        if words and h not in seen:
                            seen.add(h)
                            head, others = cut_runs(words, leading)
                            own.append(d)
                            name.append(h)
                            leaf.append(_hash(b"%d " % len(words) + b" ".join(head)) if others else None)
                            runs.append([_hash(b" ".join(run)) for run in others])
                doc = piece.column(0).take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(name, pa.int64()), pa.array(leaf, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], ["doc", "line", "leaf", "runs"])

    kind = rows.schema["_doc"].dataType.simpleString()
    where = written(rows.mapInArrow(lines, f"doc {kind}, line long, leaf long, runs array<long>"))
    distinct = where.groupBy("line").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("leaf").alias("leaf"))
    crowded = written(distinct.where("leaf is not null").groupBy("leaf").agg(F.count("line").alias("lines")).where("lines > 1").select("leaf"))
    told = written(where.select("line", "leaf", "runs").join(crowded, "leaf", "left_semi").dropDuplicates(["line"]), crowded)  # a plain join: a hot leaf is split
    templates = written(line_templates(told), told)
    named = distinct.join(templates, "line", "left").select("line", "low", "high", F.coalesce("template", "line").alias("template"))
    recurring = named.groupBy("template").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").drop("last")
    dropped = named.join(recurring, "template").where("high > first").select("line", "first")
    per_doc = where.select("doc", "line").join(dropped, "line").where("doc <> first").groupBy(F.col("doc").alias("_from")).agg(F.collect_list("line").alias("_drop"))

    same = F.col("_doc.id").eqNullSafe(F.col("_from.id")) & (F.col("_doc.hash") == F.col("_from.hash"))
    kept = F.struct(*[c for c in keep if c not in (id_col, text_col)], F.lit(True).alias("_")).alias("_kept")
    joined = docs.select(doc.alias("_doc"), F.col(text_col).alias("_text"), kept).join(per_doc, same, "left").drop("_from")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                out, counts = [], []
                for text, drop in zip(piece.column(1).to_pylist(), piece.column(3).to_pylist(), strict=True):
                    if text is None:
                        out.append(None)
                        counts.append((0, 0, 0))
                        continue
                    lines = text.split("\n")
                    gone, left, n_parsed = set(drop or ()), [], 0
                    for line in lines:
                        parsed = bool(line.encode().split())
                        n_parsed += parsed
                        if not (parsed and gone and line_name(masked(line.encode())) in gone):
                            left.append(line)
                    out.append("\n".join(left))
                    counts.append((len(lines), n_parsed, len(lines) - len(left)))
                columns = [piece.column(0), pa.array(out, pa.string()), piece.column(2), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["_doc", "_text", "_kept", "n_lines", "n_parsed", "n_dropped"])

    done = joined.mapInArrow(cut, f"_doc {kind}, _text string, _kept {joined.schema['_kept'].dataType.simpleString()}, n_lines long, n_parsed long, n_dropped long")
    own = {id_col: F.col("_doc.id").cast(docs.schema[id_col].dataType), text_col: F.col("_text")}
    passed = [F.col("_kept").getField(c).alias(c) for c in keep if c not in (id_col, text_col)]
    return done.select(*passed, own[id_col].alias("doc_id"), own[text_col].alias("text"), "n_lines", "n_parsed", "n_dropped")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
li AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL),
tk AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM li),
mk AS (SELECT *, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS m FROM tk),
w AS (SELECT r, doc_id, line, pos, CASE WHEN len(list_filter(m, lambda x: x <> '<*>')) = 0 THEN raw ELSE m END AS w FROM mk),
nm AS (SELECT *, array_to_string(w, ' ') AS name FROM w),
ln AS (SELECT name, any_value(w) AS w, min(doc_id) AS low FROM nm WHERE len(w) > 0 GROUP BY name),
hd AS (SELECT name, low, w, len(w) AS n, greatest(4, len(w) // 4) AS head FROM ln WHERE len(w) >= 8),
rn AS (SELECT *, least(6, n - head) AS k FROM hd),
runs AS (SELECT *, list_transform(range(0, k), lambda j: array_to_string(w[head + (n - head) * j // k + 1 : head + (n - head) * (j + 1) // k], ' ')) AS runs FROM rn),
ch AS (SELECT a.i, b.i AS j FROM range(0, 6) a(i), range(0, 6) b(i) WHERE a.i <= b.i),
pa AS (SELECT name, n || '|' || array_to_string(w[1 : head], ' ') || '|' || i || ',' || j || '|' ||
         array_to_string(list_transform(range(0, k), lambda x: CASE WHEN x = i OR x = j THEN '' ELSE runs[x + 1] END), chr(1)) AS path
       FROM runs, ch WHERE i < k AND j < k AND CASE WHEN k >= 6 THEN i < j WHEN k >= 3 THEN i = j ELSE false END),
lk AS (SELECT DISTINCT p.name AS x, q.least AS y FROM pa p JOIN (SELECT path, min(name) AS least FROM pa GROUP BY path HAVING count(*) > 1) q ON p.path = q.path WHERE p.name <> q.least),
bo AS (SELECT x, y FROM lk UNION SELECT y, x FROM lk),
rc AS (SELECT x AS name, x AS root FROM bo UNION SELECT b.y, rc.root FROM rc JOIN bo b ON rc.name = b.x),
tp AS (SELECT name, min(root) AS template FROM rc GROUP BY name),
t AS (SELECT nm.r, nm.doc_id, nm.line, nm.pos, len(nm.w) > 0 AS parsed, coalesce(tp.template, nm.name) AS template FROM nm LEFT JOIN tp ON nm.name = tp.name),
f AS (SELECT template, min(doc_id) AS first_doc FROM t WHERE parsed GROUP BY template),
o AS (SELECT t.*, parsed AND t.doc_id <> first_doc AS gone FROM t LEFT JOIN f ON t.template = f.template),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM o GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS text_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""
