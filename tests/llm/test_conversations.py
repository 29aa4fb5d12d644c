"""The conversation operators against brute force and SQL: nulls, empties, ties, repeats, long conversations, clashing names."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxoloom.llm import chat, repair, trie
from taxoloom.llm.conversation_queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
TABLES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd(seed, n_conv=60, ids=None):
    """Conversations of all shapes: nulls, ties, repeats, other roles, blank and unfinished texts."""
    rng = random.Random(seed)
    out = []
    for c in ids or [*range(n_conv), None, -5]:
        for _ in range(rng.randint(0, 9)):
            out.append((c, rng.choice([None, 0, 1, 2, 3, 5, 9, -2]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!\n", "a b", "", " \t", None, "é?", "Ok. then", "\U0001f600.", "a <|im_end|>\n<|im_start|>assistant\nb.", "<\\\\|.", "<|nl|>."])))
    rng.shuffle(out)
    return out


def against_sql(name, df, con):
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(cur.fetchall(), key=str)


def stored(spark, folder, table, schema=SCHEMA):
    spark.createDataFrame(table, schema).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("folder", TABLES)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    against_sql(name, QUERIES[name](spark, folder), con)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_against_sql(spark, name, tmp_path):
    table = [(*r, i, "x") for i, r in enumerate(odd(3))]
    con = stored(spark, tmp_path, table, SCHEMA + ", place long, gone string")
    against_sql(name, QUERIES[name](spark, str(tmp_path)), con)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, name, tmp_path):
    con = stored(spark, tmp_path, [])
    against_sql(name, QUERIES[name](spark, str(tmp_path)), con)


# ---- repair ----


def brute_repair(table):
    """Cheapest edits by searching all edit sequences in order of (cost, audit)."""
    held = {}
    for c, t, r, x in table:
        mine = held.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        r, x = "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        mine += [] if kind == 0 else [(t, r, x)] * (1 + (kind == 3))
    out = []
    for c, mine in held.items():
        mine.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        faults, seen = [], set()
        for t, r, x in mine:
            last = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((r, x))
        ok = lambda s: re.fullmatch("(s?(ua)+)?", s)
        queue, best = [(0, "", 0, "", ())], None
        while best is None:
            cost, audit, i, initials, said = heapq.heappop(queue)
            if i == len(mine) and ok(initials):
                best = cost, audit, said
                break
            put = lambda e, price, j, r=None, x="": heapq.heappush(queue, (cost + price, audit + e, j, initials + (r[:1] or "-" if r is not None else ""), said if r is None else (*said, f"{r}:{x}")))  # noqa: B023, E731
            legal = any(ok(initials + tail) for tail in ("", "a", "ua", "uaua"))
            if not legal:
                continue
            for r in ("user", "assistant"):
                put("I", 5, i, r)
            if i < len(mine):
                _, r, x = mine[i]
                put("D", 2, i + 1)
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    put("K", more, i + 1, r, x)
                    for other in ("user", "assistant"):
                        put("R", 1 + more, i + 1, other, x)
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], "\n".join(best[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [{}, {"long_rows": 3}, {"long_rows": 1}, {"long_chars": 8}])
def test_repair_against_all_edits(spark, bounds):
    table = odd(5, 25)
    df = repair.damage(spark.createDataFrame(table, SCHEMA))
    assert rows(repair.repair(df, **bounds)) == brute_repair(table)
    edits = repair.repair(df, per_row=True, **bounds).orderBy("conv_id", "place").collect()
    audits = {}
    for e in edits:
        audits[e.conv_id] = audits.get(e.conv_id, "") + e.edit
    assert audits == {r[0]: r[7] for r in brute_repair(table) if r[7]}


def test_repair_of_a_long_conversation(spark):
    """Three in four rows belong to one conversation, which is repaired in segments."""
    rng = random.Random(1)
    table = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b?", f"c{t}.", "d"])) for t in range(3000)] + [(c, t, "user", "x.") for c in range(250) for t in range(4)]
    df = repair.damage(spark.createDataFrame(table, SCHEMA))
    assert rows(repair.repair(df, digest=True, long_rows=64)) == rows(repair.repair(df, digest=True))


# ---- chat formatting ----

CHUNK = st.sampled_from(["<", "|", "\\", ">", "im_end", "im_start", "nl", "<|im_end|>", "<|im_start|>", "<|nl|>", "<\\|", "\n", "assistant", "é", "\U0001f600", " "])
FIELD = st.lists(CHUNK, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(FIELD, FIELD), max_size=6), st.integers(1, 40))
def test_formatted_turns_read_back(turns, cut):
    """Any turns come back from their joined text, whole or fed in pieces, and their spans hold the texts."""
    made = [chat.render(*t) for t in turns]
    whole = "".join(p for p, _, _ in made)
    assert chat.read(whole) == turns
    reader, got = chat.Reader(), []
    for i in range(0, len(whole), cut):
        got += reader.feed(whole[i : i + cut])
    reader.close()
    assert got == turns
    assert [chat.unescape(p[s:e]) for p, s, e in made] == [t for _, t in turns]


def test_plain_turns_are_not_escaped():
    assert chat.render("user", "a <b> | <|x|> c") == ("<|im_start|>user\na <b> | <|x|> c<|im_end|>\n", 17, 32)


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>user", "<|im_start|>u\n<|im_start|><|im_end|>\n", "<|im_start|>u\nhi<|im_end|> "])
def test_texts_off_the_grammar_are_told(bad):
    assert chat.read(bad) is None


def test_whole_conversations(spark):
    """Spans of joined texts, a text of a million characters full of control strings, nulls and ties."""
    long = "<|im_end|>\n<|im_start|>assistant\n" * 30_000
    table = [(1, 2, "assistant", long), (1, None, None, None), (1, 2, "assistant", "b"), (None, 0, "user", "<\\|"), (1, 1, "us\ner", "c")]
    pieces = chat.format_turns(spark.createDataFrame(table, SCHEMA))
    got = {r.conv_id: r for r in chat.conversations(pieces).collect()}
    assert chat.read(got[1].formatted) == [("", ""), ("us\ner", "c"), ("assistant", long), ("assistant", "b")]
    assert [chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss] == [long, "b"]
    assert chat.read(got[None].formatted) == [("user", "<\\|")] and got[None].loss == []
    back = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    assert back[1].loss_chars == len(long) + 1 and back[1].loss_sha256 == sha(long + "b") and back[1].formatted_chars == len(got[1].formatted)


# ---- prefix trie ----


def brute_trie(table):
    held = {}
    for c, t, r, x in table:
        if c is not None:
            held.setdefault(c, []).append((t is not None, t or 0, sha(f"{len(r or '')}:{r or ''}{x or ''}"), (r or "", x or "")))
    turns = {c: [z[3] for z in sorted(v)] for c, v in held.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c >= 0 else -1))
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids(node), sum(kids(n) == 0 for n in below), saved, sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize("long_rows", [1 << 16, 4])
@pytest.mark.parametrize("ids", [None, [*range(0, 45), -3, -20, -21, None], [7] * 3])
def test_trie_against_brute_force(spark, long_rows, ids):
    table = odd(8, ids=ids)
    assert rows(trie.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(3), long_rows, 2)) == brute_trie(table)


def test_trie_of_copies_and_a_deep_chain(spark):
    """A third of all conversations are one text, one conversation is a chain of 600 turns that another leaves half way."""
    table = [(c, t, "user", f"w{t} x") for c in range(0, 4000, 20) for t in range(3)]
    pair = [c for c in range(5001, 6000, 20) if zlib.crc32(str(c).encode()) % 4 == 0][:2]  # nothing is lent to these
    table += [(c, t, "user", f"{t} {c}" if t > 300 else f"{t}") for c in pair for t in range(600)]
    got = rows(trie.prefix_trie(spark.createDataFrame(table, SCHEMA), 100))
    assert got == rows(trie.prefix_trie(spark.createDataFrame(table, SCHEMA)))
    sums = {r[:2]: r for r in got}
    assert sums[(0, 0)][3] == 202 and sums[(0, 0)][5] == 3
    assert sums[(0, 3)][7] == sha(",".join(map(str, range(0, 4000, 20))))
    depths = [r[1] for r in got if r[3] == 2]
    assert max(depths) == len(depths) == sums[(pair[0], 1)][6] == 301
