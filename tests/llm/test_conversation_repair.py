"""Conversation repair against brute force: all edits tried, straight from the contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from rivulet.llm import conversation_repair as cr

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
EMPTY = hashlib.sha256(b"").hexdigest()


def hurt(rows):
    """rows (conv_id, turn, role, text): those after damage by conversation, and all conversations."""
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        d = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out[c] += [(t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in out.items()}


def faults_of(own):
    out, seen = [], set()
    for _, role, text in own:
        rest = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(own):
    """(cost, audit, [(role, text)]) least in that order, over all edits with up to two insertions at a place."""
    faults = faults_of(own)

    @cache
    def least(i, initials):
        # initials: what was written, as far as the pattern tells beginnings apart
        options = []
        if re.fullmatch("(s?(ua)+)?", initials) and i == len(own):
            options.append((0, "", ()))
        for role in ("user", "assistant"):
            if len(initials) < 1 or initials[-1:] != "I":
                more = grown(initials, role[0])
                if more is not None and depth(initials) < 2:
                    options += [(5 + c, "I" + a, ((role, ""), *rest)) for c, a, rest in [least(i, more + "+" * (depth(initials) + 1))] if c is not None]
        if i < len(own):
            _, role, text = own[i]
            options += [(2 + c, "D" + a, rest) for c, a, rest in [least(i + 1, bare(initials))] if c is not None]
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for label, new, cost in ((("K", role, 0),) if role else ()) + (("R", "user", 1), ("R", "assistant", 1)):
                    more = grown(bare(initials), new[0])
                    if more is not None:
                        options += [(cost + extra + c, label + a, ((new, text), *rest)) for c, a, rest in [least(i + 1, more)] if c is not None]
        elif re.fullmatch("(s?(ua)+)?", bare(initials)):
            options.append((0, "", ()))
        return min(options) if options else (None, None, None)

    def depth(x):
        return x.count("+")

    def bare(x):
        return x.replace("+", "")

    def grown(initials, c):
        x = bare(initials) + c
        if not any(re.fullmatch("(s?(ua)+)?", x + end) for end in ("", "a", "ua")):
            return None
        return x if len(x) < 4 else x[:-2]  # (ua)+ repeats

    c, a, rest = least(0, "")
    return c, a, list(rest)


def want(rows):
    out = []
    for c, own in hurt(rows).items():
        faults, turns = faults_of(own), [t for t, _, _ in own if t is not None]
        cost, audit, left = brute(own)
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_query(spark):
    for folder in (TINY, SMALL):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = cr.op11_conversation_repair(spark, folder)
        assert got.columns == [x.split()[0] for x in cr.SUMMARY.split(", ")]
        assert sorted(map(tuple, got.collect()), key=repr) == want(rows)


def odd_rows(seed):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "unknown", None]
    texts = ["a.", "b?", "c", " \t\n", "", "  d! \n", "é。", "ü.", None, "a."]
    rows = []
    for c in range(60):
        for k in range(rnd.randint(0, 9)):
            rows.append((None if c == 7 else c, None if rnd.random() < 0.1 else k + rnd.choice([0, 0, 0, 1, 30]), rnd.choice(roles), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, tmp_path, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, edit string, n int")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, cr.op11_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == want(rows)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op11_conversation_repair(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(c, 0, "user", "x.") for c in range(200)], df.schema).write.parquet(f"{tmp_path}/all/conversations.parquet")
    gone = [r for r in cr.op11_conversation_repair(spark, f"{tmp_path}/all").collect() if zlib.crc32(f"{r['conv_id']}:0".encode()) % 20 == 0]
    assert gone and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY) for r in gone)


def plain(rows):
    """The whole label string by keeping strings instead of ranks, without dropping states."""
    best = {"": (0, "")}
    for role, fault, *_ in rows:
        nxt = defaultdict(list)
        for s, (c, a) in best.items():
            for k in range(3):
                for label, initial, _, more in cr.arcs(role, fault):
                    now = cr.REACHED[s, k][0]
                    to = now if initial is None else cr.GRAMMAR[now].get(initial)
                    if to is not None:
                        nxt[to].append((c + 5 * k + more, a + "I" * k + label))
        best = {s: min(x) for s, x in nxt.items()}
    return min((c + 5 * k, a + "I" * k) for s, (c, a) in best.items() for k in range(3) if cr.REACHED[s, k][0] in cr.FINAL)


def test_long_conversations_stream(monkeypatch):
    rnd = random.Random(9)
    for undecided in (1, 3, 40):
        monkeypatch.setattr(cr, "UNDECIDED", undecided)
        for _ in range(60):
            rows = [(rnd.choice(["user", "assistant", "system", " ", "tool"]), rnd.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(rnd.randint(0, 120))]
            got = list(cr.cheapest_edits(iter(rows)))
            cost = sum(cr.COST[e] + (5 if t and t[1] == "truncated" and e != "D" else 0) for e, _, t in got)
            assert (cost, "".join(e for e, _, _ in got)) == plain(rows)
            assert [t for _, _, t in got if t] == rows
    # what all paths agree on is passed on before the conversation ends
    seen = []

    def watched():
        for k in range(5000):
            seen.append(k)
            yield ("user", "assistant")[k % 2], None

    monkeypatch.setattr(cr, "UNDECIDED", 64)
    stream = cr.cheapest_edits(watched())
    next(stream)
    assert len(seen) < 200
