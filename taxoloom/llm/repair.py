"""Operator 11: conversations are given a legal order of roles by their cheapest edits.

A legal conversation has the role initials ``(s?(ua)+)?``. A row is kept, given another role or deleted, empty rows may
be inserted; the cheapest way is found by dynamic programming over turns, for all conversations of a bucket of lengths
at once: arrays are laid out time first, so one turn of all conversations is one vectorised step. Costs to the end are
stored backwards, then edits are traced forwards, again for all conversations at once.

A conversation of more than ``long_rows`` rows or ``long_chars`` characters is never held by one task: its rows get
places by ranges, its turns are cut into segments, each a 4 x 4 matrix of costs between states; the matrices are
combined backwards, the traces forwards (a row a segment), and only a stream of its rows passes one task, as the digest
of a whole text must.

Nulls in role and text count as one space, null turns come first and are no part of gaps, a null conv_id is a
conversation of its own; rows of equal turn are taken by role and text. An empty table gives no rows; other columns are
ignored. Very long texts stay in their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import ranked
from ._run import lean, ready, written

SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated row costs unless it is deleted (fixed values).
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Edits by their initials in ASCII order, so the first of several cheapest ones is the least.
EDITS = "DIKR"
#: States: nothing yet, after system, after user, after assistant. The next one by the initials s, u, a, or none.
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The one state that an inserted or changed row can lead to, and its role.
FREE = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 40
END = np.array([0, FAR, FAR, 0])
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
#: A turn's code is 4 x fault + initial (s, u, a, other); PAD stands after a conversation's end.
PAD = 16
_fault, _initial = np.divmod(np.arange(PAD + 1), 4)
_live = (_fault < BLANK)[:, None]
_kept_to = NEXT.T[_initial]
KEEP_COST = np.where(_live & (_kept_to >= 0), CUT * (_fault == TRUNCATED)[:, None], FAR)
KEEP_TO = np.maximum(_kept_to, 0)
REROLE_COST = np.where(_live, REROLE + CUT * (_fault == TRUNCATED)[:, None], FAR)
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
ROWS = "conv_id long, place long, edit string, turn long, role string, text string"
BATCH_ROWS = 1 << 14


def _inserted(cost: np.ndarray) -> np.ndarray:
    for _ in range(2):  # no way needs more than two insertions before it comes round
        cost = np.minimum(cost, INSERT + cost[:, FREE])
    return cost


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [turn, conversation, state] from before each turn to the end; codes [turn, conversation]."""
    costs = np.empty((len(codes) + 1, codes.shape[1], 4), np.int64)
    costs[-1] = end
    rows = np.arange(codes.shape[1])[:, None]
    for t in range(len(codes) - 1, -1, -1):
        after, code = costs[t + 1], codes[t]
        kept = KEEP_COST[code] + after[rows, KEEP_TO[code]]
        best = np.minimum(np.minimum(DELETE + after, kept), REROLE_COST[code] + after[:, FREE])
        costs[t] = np.where((code == PAD)[:, None], after, np.minimum(_inserted(best), FAR))
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, lengths: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest edits [step, conversation] as places in EDITS (-1: over), the states that they lead to, and the last states.

    Only a part that is a conversation's last may insert after its rows.
    """
    rows, t, state = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64), state.copy()
    edits, states = [], []
    while True:
        inside = t < lengths
        going = inside | (last & (END[state] > 0))
        if not going.any():
            break
        after = costs[np.minimum(t + 1, len(codes)), rows]
        code = codes[np.minimum(t, len(codes) - 1), rows] if len(codes) else np.full(len(rows), PAD)
        kept, free = KEEP_TO[code, state], FREE[state]
        ways = np.stack([DELETE + after[rows, state], INSERT + costs[t, rows, free], KEEP_COST[code, state] + after[rows, kept], REROLE_COST[code, 0] + after[rows, free]])
        ways[:, ~inside] = np.array([1, 0, 1, 1])[:, None]
        edit = np.where(going, ways.argmin(0), -1)
        state = np.select([edit == 2, (edit == 1) | (edit == 3)], [kept, free], state)
        t = t + (going & (edit != 1))
        edits.append(edit)
        states.append(state)
    if not edits:
        return np.empty((0, len(rows)), np.int64), np.empty((0, len(rows)), np.int64), state
    return np.stack(edits), np.stack(states), state


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of conversations whose lengths lie between two powers of two."""
    kind = np.frexp(np.maximum(lengths - 1, 0))[1]
    for k in np.unique(kind):
        yield np.flatnonzero(kind == k)


def time_major(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The flat codes as [turn, conversation], padded to the longest."""
    steps = np.arange(lengths.max(initial=0))[:, None]
    at = np.minimum(starts[None, :] + steps, max(len(codes) - 1, 0))
    return np.where(steps < lengths[None, :], codes[at] if len(codes) else PAD, PAD)


def illegal_pairs(initials: np.ndarray) -> np.ndarray:
    """Whether each initial and the next (s, u, a, other as numbers) are other than su, ua, au."""
    pair = initials[:-1] * 4 + initials[1:]
    return ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))


def damage(df: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes ``.!?`` away, 3 repeats, 4 makes it the user's.

    A dropped row stays as a mark, ``gone``, so that a conversation without rows is known.
    """
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    out = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def plain(df: DataFrame) -> DataFrame:
    """Rows as they are, for ``repair``."""
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def _coded(rows: DataFrame) -> DataFrame:
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("s", 0), ("u", 1), ("a", 2)) for x in p]), F.substring("role", 1, 1)), F.lit(3))
    return rows.withColumn("code", (fault * 4 + initial).cast("int"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole conversations of a sorted stream, and where each starts."""
    rest = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        starts = _starts(held)
        if len(starts) > 1 and held.num_rows >= BATCH_ROWS // 4:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1])
        rest = held
    if rest is not None and rest.num_rows:
        yield rest, _starts(rest)


def _starts(table: pa.Table) -> np.ndarray:
    ids = table.column("conv_id").combine_chunks()
    value, there = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (there[1:] != there[:-1])])[: table.num_rows])


def _mend(table: pa.Table, starts: np.ndarray, per_row: bool, digest: bool) -> Iterator[tuple]:
    gone = table.column("gone").to_numpy()
    ids = [x.as_py() for x in table.column("conv_id").take(pa.array(starts))]
    live = np.flatnonzero(~gone)
    owner = np.searchsorted(starts, live, side="right") - 1
    kept = table.take(pa.array(live))
    turns, roles, texts = (kept.column(c).to_pylist() for c in ("turn", "role", "text"))
    codes = kept.column("code").to_numpy().astype(np.int64).copy()
    seen, at = set(), -1
    for i, o in enumerate(owner.tolist()):
        if o != at:
            seen, at = set(), o
        said = (roles[i], texts[i])
        if said in seen and codes[i] // 4 != BLANK:
            codes[i] = DUPLICATE * 4 + codes[i] % 4
        seen.add(said)
    first = np.searchsorted(owner, np.arange(len(starts)))
    lengths = np.searchsorted(owner, np.arange(len(starts)), side="right") - first
    illegal = np.zeros(len(starts), np.int64)
    if len(live) > 1:
        np.add.at(illegal, owner[1:], (owner[1:] == owner[:-1]) & illegal_pairs(codes % 4))
    faults = np.zeros((len(starts), 4), np.int64)
    np.add.at(faults, (owner, codes // 4), 1)
    for bucket in buckets(lengths):
        n, start = lengths[bucket], first[bucket]
        grid = time_major(codes, start, n)
        end = np.broadcast_to(_inserted(END[None, :]), (len(bucket), 4))
        costs = backward(grid, end)
        edits, states, _ = trace(grid, costs, n, np.zeros(len(bucket), np.int64), np.ones(len(bucket), bool))
        for j, c in enumerate(bucket.tolist()):
            steps = edits[:, j][edits[:, j] >= 0].tolist()
            i, lines, rows = int(start[j]), [], []
            for k, e in enumerate(steps):
                role = None if e == 0 else roles[i] if e == 2 else ROLE[int(states[k, j])]
                text = "" if e == 1 else texts[i]
                if per_row:
                    rows.append((ids[c], k + 1, EDITS[e], None if e == 1 else turns[i], roles[i] if e == 0 else role, text))
                elif e:
                    lines.append(f"{role}:{text}")
                i += e != 1
            if per_row:
                yield from rows
                continue
            known = [t for t in turns[int(start[j]) : int(start[j] + n[j])] if t is not None]
            gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
            whole = "\n".join(lines)
            yield ids[c], gaps, *(int(faults[c, f]) for f in (BLANK, DUPLICATE, TRUNCATED)), int(illegal[c]), int(costs[0, j, 0]), "".join(EDITS[e] for e in steps), _sha(whole) if digest else whole


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


def _packed(records: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in records:
        held.append(r)
        weight += 64 + sum(len(x) for x in r if isinstance(x, str))
        if weight >= size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _short(rows: DataFrame, per_row: bool, digest: bool) -> DataFrame:
    schema = ROWS if per_row else OUT
    dealt = _coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        yield from _packed((r for table, starts in _whole(batches) for r in _mend(table, starts, per_row, digest)), _arrow(schema))

    return dealt.mapInArrow(lean(run), schema)


# ---- conversations beyond the bounds ----


def _segment_grid(codes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    return time_major(codes.flatten().to_numpy().astype(np.int64), np.cumsum(lengths) - lengths, lengths), lengths


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's costs from each state before it to each state after it, and its illegal pairs."""
    for b in batches:
        grid, lengths = _segment_grid(b.column("codes"))
        ways = np.stack([backward(grid, np.where(np.arange(4) == j, 0, FAR))[0] for j in range(4)], 2).reshape(-1, 16)
        pairs = [int(illegal_pairs(grid[:n, j] % 4).sum()) for j, n in enumerate(lengths.tolist())]
        yield pa.record_batch([b.column("key"), b.column("segment"), b.column("codes"), pa.array(ways.tolist(), pa.list_(pa.int64())), pa.array(pairs, pa.int64())], names=["key", "segment", "codes", "ways", "pairs"])


def _ends(part: pd.DataFrame) -> pd.DataFrame:
    """Costs after each segment, from the last back; a row a segment."""
    part = part.sort_values("segment", ascending=False)
    end, out = _inserted(END[None, :])[0], []
    for ways in part["ways"]:
        out.append(end.tolist())
        end = np.minimum((np.asarray(ways).reshape(4, 4) + end[None, :]).min(1), FAR)
    return pd.DataFrame({"key": part["key"], "segment": part["segment"], "end": out, "last": [i == 0 for i in range(len(out))], "cost": int(end[0])})


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's edits and its last state for each of the four states that it may start from."""
    for b in batches:
        grid, lengths = _segment_grid(b.column("codes"))
        last = np.array(b.column("last").to_pylist(), bool)
        costs = backward(grid, np.array(b.column("end").to_pylist(), np.int64).reshape(-1, 4))
        finals, audits, roles = [], [], []
        for q in range(4):
            edits, states, final = trace(grid, costs, lengths, np.full(len(last), q), last)
            finals.append(final)
            audits.append(["".join(EDITS[e] for e in edits[:, j] if e >= 0) for j in range(len(last))])
            roles.append(["".join(str(s) for s, e in zip(states[:, j], edits[:, j]) if e >= 0) for j in range(len(last))])
        names = ["key", "segment", "finals", "audits", "states"]
        lists = [pa.array([[x[j] for x in way] for j in range(len(last))], pa.list_(pa.string())) for way in (audits, roles)]
        yield pa.record_batch([b.column("key"), b.column("segment"), pa.array(np.stack(finals, 1).tolist(), pa.list_(pa.int64())), *lists], names=names)


def _begins(part: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment starts from; a row a segment."""
    part = part.sort_values("segment")
    state, out = 0, []
    for finals in part["finals"]:
        out.append(state)
        state = int(finals[state])
    return pd.DataFrame({"key": part["key"], "segment": part["segment"], "begin": out})


def _joined(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[tuple]:
    """Of a sorted stream of edits: each conversation's audit and repaired text or its digest."""
    key, audit, hasher, lines, first = None, [], None, [], True
    for b in batches:
        for k, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "edit", "role", "text"))):
            if k != key:
                if key is not None:
                    yield key, "".join(audit), hasher.hexdigest() if digest else "\n".join(lines)
                key, audit, hasher, lines, first = k, [], hashlib.sha256(), [], True
            audit.append(edit)
            if edit != "D":
                line = f"{role}:{text}"
                if digest:
                    hasher.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
                else:
                    lines.append(line)
                first = False
    if key is not None:
        yield key, "".join(audit), hasher.hexdigest() if digest else "\n".join(lines)


def _long(rows: DataFrame, segment: int, per_row: bool, digest: bool) -> DataFrame:
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    coded = _coded(rows).withColumn("key", key).withColumn("said", said)
    live = written(ranked(coded.where("not gone").drop("gone"), ["key"], [F.col("turn").asc_nulls_first(), "role", "text"]), "repair-long").df
    firsts = live.groupBy("key", "said").agg(F.min("place").alias("first"))
    repeated = (F.col("place") > F.col("first")) & (F.floor(F.col("code") / 4) != BLANK)
    codes = live.join(firsts, ["key", "said"]).select("key", "place", F.when(repeated, DUPLICATE * 4 + F.col("code") % 4).otherwise(F.col("code")).cast("int").alias("code"))
    codes = codes.withColumn("segment", F.floor((F.col("place") - 1) / segment))
    parts = codes.groupBy("key", "segment").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("held"), *(F.sum((F.floor(F.col("code") / 4) == f).cast("long")).alias(c) for f, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))))
    parts = written(parts.select("key", "segment", "blank", "duplicate", "truncated", F.col("held")[0]["code"].alias("head"), F.element_at("held", -1)["code"].alias("tail"), F.transform("held", lambda x: x["code"]).alias("codes")), "repair-segments").df
    ways = parts.select("key", "segment", "codes").mapInArrow(_matrices, "key string, segment long, codes array<int>, ways array<long>, pairs long")
    ways = written(ways, "repair-ways").df
    ends = written(ways.groupBy("key").applyInPandas(_ends, "key string, segment long, end array<long>, last boolean, cost long"), "repair-ends").df
    traced = written(ways.select("key", "segment", "codes").join(ends.drop("cost"), ["key", "segment"]).mapInArrow(_traces, "key string, segment long, finals array<long>, audits array<string>, states array<string>"), "repair-traces").df
    begins = traced.select("key", "segment", "finals").groupBy("key").applyInPandas(_begins, "key string, segment long, begin int")
    chosen = traced.join(begins, ["key", "segment"]).select("key", "segment", F.col("audits")[F.col("begin")].alias("audit"), F.col("states")[F.col("begin")].alias("state"))
    steps = chosen.where("audit <> ''").select("key", "segment", F.posexplode(F.split("audit", "")).alias("step", "edit"), "audit", "state")
    own = F.length(F.translate(F.substring(F.col("audit"), F.lit(1), F.col("step") + 1), "I", ""))
    steps = steps.select("key", "segment", "step", "edit", F.substring(F.col("state"), F.col("step") + 1, F.lit(1)).alias("to"), F.when(F.col("edit") != "I", F.col("segment") * segment + own).alias("place"))
    given = F.when(F.col("to") == "2", ROLE[2]).otherwise(ROLE[3])
    edits = steps.join(live.select("key", "place", "turn", "role", "text"), ["key", "place"], "left").select(
        "key", "segment", "step", "edit", "turn", F.when(F.col("edit").isin("I", "R"), given).otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    back = F.when(F.col("key") != "", F.col("key").cast("long")).alias("conv_id")
    if per_row:
        return ranked(edits, ["key"], ["segment", "step"]).select(back, "place", "edit", "turn", "role", "text")
    joined = edits.repartition("key").sortWithinPartitions("key", "segment", "step").select("key", "edit", "role", "text")
    names = "key string, audit string, repaired string"
    joined = joined.mapInArrow(lambda batches: _packed(_joined(batches, digest), _arrow(names)), names)
    before = F.lag("tail").over(Window.partitionBy("key").orderBy("segment")) % 4 * 4 + F.col("head") % 4
    borders = parts.select("key", "blank", "duplicate", "truncated", F.coalesce((~before.isin(1, 6, 9)).cast("long"), F.lit(0)).alias("border"))
    faults = borders.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "border")))
    inner = ways.groupBy("key").agg(F.sum("pairs").alias("pairs"))
    spans = live.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    known = spans.join(faults, "key").join(inner, "key").join(ends.where("segment = 0").select("key", "cost"), "key").join(joined, "key")
    every = rows.select(key.alias("key")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.join(known, "key", "left").select(
        back, *(zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")), zero(F.col("pairs") + F.col("border")).alias("illegal"), zero(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit(_sha("") if digest else "")).alias("repaired"),
    )


def repair(rows: DataFrame, per_row: bool = False, digest: bool = False, long_rows: int = 4096, long_chars: int = 1 << 24) -> DataFrame:
    """Repaired conversations of rows conv_id, turn, role, text and gone (see ``plain`` and ``damage``).

    One row a conversation: its faults, the least cost, the edits' initials and the repaired rows as one text (by
    ``digest`` its SHA-256); by ``per_row`` one row an edit, deleted rows included. Conversations beyond ``long_rows``
    or ``long_chars`` are repaired in segments of ``long_rows`` turns with the same result.
    """
    spark = rows.sparkSession
    ready(spark)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv_id").alias("_long")), "repair-sizes")
    if long.df.isEmpty():
        long.drop()
        return _short(rows, per_row, digest)
    same = rows["conv_id"].eqNullSafe(long.df["_long"])
    return _short(rows.join(long.df, same, "left_anti"), per_row, digest).union(_long(rows.join(long.df, same, "left_semi"), long_rows, per_row, digest))
