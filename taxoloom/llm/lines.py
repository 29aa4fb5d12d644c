"""Line dedup: maximal repeated runs of lines from a suffix array over line ids; later copies are deleted.

Lines are trimmed and named by their MD5; blank lines are passed over. The suffixes of all documents' line
sequences are sorted by prefix doubling: level r ranks every window of ``2**r`` lines by the pair of ranks of
its halves, in order. Only windows that occur at least twice keep a rank and go on, for a window that occurs
once has found its place; so each level holds fewer rows, and the doubling ends by itself when no window
repeats. Suffixes that share a rank at level r are an interval of the suffix array whose longest common
prefix is at least ``2**r`` lines.

A suffix that leaves at level r + 1 has a longest common prefix with its neighbours of ``2**r`` lines or more,
but under ``2**(r + 1)``. Going down the levels again narrows every such interval by half a length at a time:
the members of an interval of prefix length n that agree in their next ``2**s`` lines are an interval of
length ``n + 2**s``. Those that find no partner keep n. This gives ``run``, the exact length of the longest
run that starts at a place and starts elsewhere too. A run is maximal if the place before it hasn't a run
longer by one.

A line is deleted if it stands in a later copy of a run of at least ``least_lines`` lines (1 by default, so
every later copy of a line goes, however short). Copies are ordered by id, hash of the text, row and place;
the first one stays. With one line this is the first member of its interval at level 0; with m lines, of the
interval of its m-line window.

Each level sorts the distinct pairs only, after counting them with partial aggregation, and joins ranks back
to windows, a join that Spark can split where one line or run is very common. Rows equal in all columns are one
row with a count: the first of them is treated as any other, the later ones lose all lines (if they have
``least_lines``). Rows of one id that differ are told apart by the MD5 of all columns. Null texts have no lines
and stay null. Ids sort with null first. An empty table gives no rows. A text of any length is one row until its
lines are exploded as hashes. Other columns of any name are carried along or left out, unread.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ._run import Written, lean, ready, written
from ._skew import join_counted


def _documents(rows: DataFrame, text: str) -> Written:
    """Distinct rows by ``_key``: a number _r, their count (2 for more), id, MD5 of the text and of its lines that aren't blank."""
    parts = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    hashed = F.transform(F.filter(parts, lambda x: x["line"] != ""), lambda x: F.struct(x["pos"].alias("pos"), F.unhex(F.md5(x["line"])).alias("h")))
    named = rows.select("_key", F.struct("_id", F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("t"), F.coalesce(hashed, F.array()).alias("lines")).alias("v"))
    one = named.groupBy("_key").agg(F.first("v").alias("v"), F.count("*").alias("copies"))
    return written(one.select("_key", F.monotonically_increasing_id().alias("_r"), F.least("copies", F.lit(2)).cast("int").alias("c"), "copies", "v._id", F.col("v.t").alias("_t"), "v.lines"), "lines-documents")


def _ranked(groups: DataFrame, keys: list[str], name: str) -> Written:
    """Rank of each key that ``c`` rows share, for c over 1, in key order."""
    return written(groups.where("c > 1").drop("c").orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def _ahead(by: int):
    return Window.partitionBy("_r").orderBy("seq").rangeBetween(by, by)


def levels_of(lines: DataFrame, most_levels: int = 40) -> list[Written]:
    """Rows (_r, seq, c, rank) of the windows of 1, 2, 4, ... lines that occur at least twice; the last level is empty."""
    ranks = _ranked(lines.groupBy("h").agg(F.sum("c").alias("c")), ["h"], "lines-rank")
    levels = [written(lines.join(ranks.df, "h").select("_r", "seq", "c", "rank"), "lines-level")]
    ranks.drop()
    for r in range(most_levels):
        if r and levels[-1].df.isEmpty():
            return levels
        pairs = levels[-1].df.withColumn("rank2", F.first("rank").over(_ahead(1 << r))).where("rank2 is not null").withColumnRenamed("rank", "rank1")
        ranks = _ranked(pairs.groupBy("rank1", "rank2").agg(F.sum("c").alias("c")), ["rank1", "rank2"], "lines-rank")
        levels.append(written(pairs.join(ranks.df, ["rank1", "rank2"]).select("_r", "seq", "c", "rank"), "lines-level"))
        ranks.drop()
    raise RuntimeError(f"runs still repeat after {most_levels} doublings")


def longest_runs(levels: list[Written]) -> DataFrame:
    """(_r, seq, run): the length of the longest run that starts at each place and also starts elsewhere."""
    top = len(levels) - 2  # the highest level with rows
    done = levels[0].df.join(levels[1].df, ["_r", "seq"], "left_anti").select("_r", "seq", F.lit(1).cast("long").alias("run"))
    open_ = None
    for r in range(top, 0, -1):
        # intervals that hold a place whose run ends between this level and the next, with all their members
        more = levels[r + 1].df.select("_r", "seq", F.lit(True).alias("_more"))
        ends = levels[r].df.join(more, ["_r", "seq"], "left").select("_r", "seq", "c", "rank", F.col("_more").isNull().alias("own"))
        ends = ends.select("_r", "seq", "c", F.concat(F.lit(f"{r}:"), "rank").alias("g"), F.lit(1 << r).cast("long").alias("n"), "own")
        spread = ends if open_ is None else ends.union(open_.df)
        step = 1 << (r - 1)
        nxt = levels[r - 1].df.select("_r", F.col("seq").alias("_at"), F.col("rank").alias("k"))
        looked = written(spread.withColumn("_at", F.col("seq") + F.col("n")).join(nxt, ["_r", "_at"], "left").select("_r", "seq", "c", "g", "n", "own", "k"), "lines-looked")
        # a partner in the next lines makes a longer interval, open if a place of its own is in it
        pairs = looked.df.where("k is not null").groupBy("g", "k").agg((F.sum("c") > 1).alias("two"), F.max("own").alias("some"))
        grown = written(pairs.where("two and some").select("g", "k"), "lines-grown")  # as a table, so that Spark can split the joins with it
        longer = looked.df.join(grown.df, ["g", "k"]).select("_r", "seq", "c", F.concat_ws(".", "g", "k").alias("g"), (F.col("n") + step).alias("n"), "own")
        # those that found none keep the old interval open, and its other members serve them
        kept = looked.df.join(grown.df.withColumn("_hit", F.lit(True)), ["g", "k"], "left").select("_r", "seq", "c", "g", "n", (F.col("own") & F.col("_hit").isNull()).alias("own"))
        needed = kept.where("own").select("g").distinct()
        new = written(longer.union(kept.join(needed, "g", "left_semi").select("_r", "seq", "c", "g", "n", "own")), "lines-open")
        looked.drop()
        grown.drop()
        if open_ is not None:
            open_.drop()
        open_ = new
    if open_ is not None:
        done = done.union(open_.df.where("own").select("_r", "seq", F.col("n").alias("run")))
    return done


def repeated_runs(documents: DataFrame, least_lines: int = 1, most_levels: int = 40) -> DataFrame:
    """Per row ``_r``: places of the lines to delete, the longest repeated run and the number of maximal ones."""
    spread = documents.select("_r", "c", "_id", "_t", F.posexplode("lines").alias("seq", "x"))
    lines = written(spread.select("_r", "c", "_id", "_t", "seq", F.col("x.pos").alias("pos"), F.col("x.h").alias("h")), "lines-base")
    place = F.struct("_id", "_t", "_r", "seq")
    levels = levels_of(lines.df, most_levels)
    if least_lines == 1:
        windows = lines.df.withColumn("w", F.col("h"))
    else:
        r = min(least_lines.bit_length() - 1, len(levels) - 1)
        ranks = levels[r].df.withColumn("rank2", F.first("rank").over(_ahead(least_lines - (1 << r)))).where("rank2 is not null")
        windows = lines.df.join(ranks.select("_r", "seq", F.struct("rank", "rank2").alias("w")), ["_r", "seq"])
    firsts = written(windows.groupBy("w").agg(F.count("*").alias("many"), F.min(place).alias("first")).where("many > 1"), "lines-firsts")
    later = join_counted(windows, firsts.df, ["w"], lines.df.count()).where(~F.col("first").eqNullSafe(place))
    if least_lines > 1:
        covered = later.select("_r", F.explode(F.sequence("seq", F.col("seq") + F.lit(least_lines - 1))).alias("seq")).distinct()
        later = covered.join(lines.df.select("_r", "seq", "pos"), ["_r", "seq"])
    gone = later.groupBy("_r").agg(F.collect_list("pos").alias("gone"))
    runs = longest_runs(levels)
    before = F.lag(F.struct("seq", "run")).over(Window.partitionBy("_r").orderBy("seq"))
    starts = ~F.coalesce((before["seq"] == F.col("seq") - 1) & (before["run"] == F.col("run") + 1), F.lit(False))
    per_row = runs.withColumn("_new", starts).groupBy("_r").agg(F.max("run").alias("longest_run"), F.sum(F.col("_new").cast("long")).alias("n_runs"))
    out = written(per_row.join(gone, "_r", "left"), "lines-gone")
    lines.drop()
    firsts.drop()
    for t in levels:
        t.drop()
    return out.df


def dedup(docs: DataFrame, least_lines: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Delete later copies of repeated runs of lines.

    With ``digest``: id, n_lines (that aren't blank), n_removed, kept_sha256, longest_run and n_runs (maximal
    repeated runs). Else all columns of ``docs`` with the text shortened (a text that loses nothing stays as
    it is), and n_removed, longest_run and n_runs unless such columns exist.
    """
    ready(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, ident = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    plain = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    if digest:
        plain = plain.select(*dict.fromkeys((ident, text)))
    whole = F.to_json(F.struct(*plain.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    plain = plain.withColumn("_key", F.unhex(F.md5(whole)))
    documents = _documents(plain.select("_key", F.col(ident).alias("_id"), F.col(text).alias("_text")), "_text")
    found = repeated_runs(documents.df, least_lines)
    named = documents.df.select("_r", "_key", "copies").join(found, "_r", "left").where("copies > 1 or longest_run is not null")
    facts = written(named.select("_key", "copies", "gone", "longest_run", "n_runs"), "lines-facts")
    documents.drop()
    kept = [ident] if digest else [c for c in names if c != text]
    counts = ["n_lines", "n_removed", "longest_run", "n_runs"]
    schema = StructType([plain.schema[c] for c in kept])
    for c in (*counts, "_times"):
        schema = schema.add(c, LongType())
    schema = schema.add("out", StringType())

    def run(batches):
        at = len(kept)
        for b in batches:
            n, removed, out = [], [], []
            for raw, away, later in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), b.column(at + 4).to_pylist(), strict=True):
                parts = (raw or "").split("\n")
                places = [i for i, x in enumerate(parts) if x.strip(" ")]
                n.append(len(places))
                away = set(away or ()) if not later else set(places) if len(places) >= least_lines else set()
                removed.append(len(away))
                left = "\n".join([x for i, x in enumerate(parts) if i not in away]) if away else raw
                out.append(hashlib.sha256((left or "").encode("utf-8", "surrogatepass")).hexdigest() if digest else left)
            known = [b.column(at + k).fill_null(0).cast(pa.int64()) for k in (2, 3)]
            times = pa.array([c - 1 if later else 1 for later, c in zip(b.column(at + 4).to_pylist(), b.column(at + 5).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(at)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), *known, times, pa.array(out, pa.string())],
                [*kept, *counts, "_times", "out"],
            )

    values = F.struct(*(c for c in plain.columns if c != "_key"))
    one = plain.groupBy("_key").agg(F.first(values).alias("v"))  # of rows equal in all columns; copies come back below
    joined = one.join(facts.df, "_key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    both = joined.withColumn("later", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    done = both.select(*(F.col(f"v.{c}").alias(c) for c in (*kept, text)), "gone", "longest_run", "n_runs", "later", "copies").mapInArrow(lean(run), schema)
    done = done.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    if digest:
        return done.select(F.col(ident).alias(id_col), "n_lines", "n_removed", F.col("out").alias("kept_sha256"), "longest_run", "n_runs")
    back = [F.col("out" if c == text else c).alias(o) for c, o in zip(names, docs.columns, strict=True)]
    return done.select(*back, *(c for c in counts[1:] if c not in docs.columns))


#: Deletions, and runs by growing windows one line at a time.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS r, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), l AS (
  SELECT r, i AS pos, trim(x[i]) AS line FROM d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)
), s AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos) AS seq FROM l WHERE line <> ''
), g AS (
  SELECT r, list(pos) AS gone FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY r, seq) AS nth FROM s) WHERE nth > 1 GROUP BY r
), w AS (
  SELECT 1 AS n, r, seq, k FROM (SELECT r, seq, dense_rank() OVER (ORDER BY line) AS k, count(*) OVER (PARTITION BY line) AS c FROM s) WHERE c > 1
  UNION ALL
  SELECT n, r, seq, k FROM (
    SELECT a.n + 1 AS n, a.r, a.seq, dense_rank() OVER (ORDER BY a.k, b.k) AS k, count(*) OVER (PARTITION BY a.k, b.k) AS c
    FROM w a JOIN w b ON a.r = b.r AND a.seq + 1 = b.seq
  ) WHERE c > 1
), m AS (
  SELECT r, seq, max(n) AS run FROM w GROUP BY r, seq
), q AS (
  SELECT r, max(a.run) AS longest_run, count(*) FILTER (b.run IS NULL OR b.run <> a.run + 1) AS n_runs
  FROM (SELECT *, seq - 1 AS before FROM m) a LEFT JOIN (SELECT r AS r2, seq AS seq2, run FROM m) b ON a.r = b.r2 AND a.before = b.seq2 GROUP BY r
)
SELECT doc_id, len(list_filter(x, lambda v: trim(v) <> ''))::BIGINT AS n_lines, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(x, lambda v, i: g.gone IS NULL OR NOT list_contains(g.gone, i)), chr(10))) AS kept_sha256,
       coalesce(longest_run, 0)::BIGINT AS longest_run, coalesce(n_runs, 0)::BIGINT AS n_runs
FROM d LEFT JOIN g ON d.r = g.r LEFT JOIN q ON d.r = q.r
"""
