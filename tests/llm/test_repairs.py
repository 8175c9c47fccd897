"""Filter audit, repeated bytes and turn repair against brute force, odd tables and their own pieces."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import audit, repeats, turns

from .conftest import odd_rows, table

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    for b in BLANK[1:]:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


# --- filter audit ---------------------------------------------------------------------------------------------

def audit_rows(rows, labels):
    """Every order applied left to right to every row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in rows:
        w, t = words(t or ""), t or ""
        fails.append((s or "", {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > least[t])) if bad}, i in good, i in toxic))
    out, lost = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                c = Counter()
                for p, bad, g, x in fails:
                    if p != part:
                        continue
                    earlier = bool(bad & set(order[:k]))
                    c["kept"] += not earlier and f not in bad
                    c["redundant"] += earlier and f in bad
                    c["unique"] += bad == {f}
                    if not earlier and f in bad:
                        c["removed"] += 1
                        c["good"] += g
                        c["toxic"] += x
                lost[part, f] += c["removed"]
                out[part, order, k + 1] = [c[n] for n in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {key: (*v, lost[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_result(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_audit_retracts_over_batches(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", None, "a b " * 30, "Loud TEXT $", " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60)) + " #"]
    rows = [(rng.randint(0, 40) if k % 9 else None, rng.choice(texts), rng.choice(["a", "b", None, ""])) for k in range(90)]
    marks = [(k, k % 2, k % 3 == 0) for k in range(0, 40, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None)]
    labels = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in marks], "doc_id long, quality int, toxic int")
    for k in range(6):  # larger ids in the first files, so that later files retract
        part = sorted(rows, key=lambda r: -(r[0] or 0))[k * 15:(k + 1) * 15]
        table(spark, part).coalesce(1).write.parquet(f"{tmp_path}/d/{k}")
    from pathlib import Path
    for k, p in enumerate(sorted(Path(tmp_path, "d").rglob("part-*.parquet"))):
        (tmp_path / "flat").mkdir(exist_ok=True)
        (tmp_path / "flat" / f"{k}.parquet").write_bytes(p.read_bytes())
    want = audit_rows(rows, [(i, q, t) for i, q, t in marks])
    for files in (1, None):
        assert audit_result(audit.filter_audit(spark, f"{tmp_path}/flat", labels, files_per_batch=files)) == want


def test_audit_of_odd_and_empty_tables(spark, tmp_path, odd, none, labels):
    odd.write.parquet(f"{tmp_path}/odd")
    got = audit_result(audit.filter_audit(spark, f"{tmp_path}/odd", labels))
    assert got == audit_rows(odd_rows(), [tuple(r) for r in labels.collect()])
    none.write.parquet(f"{tmp_path}/none")
    assert audit_result(audit.filter_audit(spark, f"{tmp_path}/none", labels)) == {}


def test_audit_of_a_table_runs_in_several_batches(spark, tmp_path, labels, monkeypatch):
    rows = [(k % 37, f"text {k % 5}", "ab"[k % 2]) for k in range(400)]
    table(spark, rows[::-1]).repartition(20).write.parquet(f"{tmp_path}/many")
    monkeypatch.setattr(audit, "BATCH_BYTES", 1, raising=False)
    monkeypatch.setattr(audit, "checkpoint_dir", lambda df: f"{tmp_path}/kept")
    got = audit_result(audit.filter_audit(spark, f"{tmp_path}/many", labels))
    assert got == audit_rows(rows, [tuple(r) for r in labels.collect()])
    batches = [p for p in (tmp_path / "kept").glob("*/state/commits/*") if p.name.isdigit()]
    assert audit.BATCHES <= len(batches) <= audit.BATCHES + 2


# --- repeated bytes -------------------------------------------------------------------------------------------

def removed(rows, span=repeats.SPAN):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[p:p + span] for _, b in texts for p in range(len(b) - span + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - span + 1):
            if seen[b[p:p + span]] > 1:
                gone[p:p + span] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("limit", [repeats.LIMIT, 2])
def test_repeated_bytes(spark, odd, none, limit):
    rng = random.Random(9)
    alphabet = "ab é"
    passage = "".join(rng.choice(alphabet) for _ in range(700))
    rows = [(i, t, s) for i, t, s in odd_rows() if len(t or "") < 50_000]
    for k in range(40):  # one passage with other surroundings, cut at other places; runs of one and two letters
        a, b = sorted(rng.sample(range(700), 2))
        rows.append((100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) + passage[a:b], "p"))
    rows += [(200, "x" * 199, "a"), (201, "x" * 200, "a"), (202, "xy" * 300, "a"), (203, passage[:200], "a"), (204, passage[:199], "a")]
    assert bytes_result(repeats.repeated_bytes(table(spark, rows).repartition(5), limit)) == removed(rows)
    assert bytes_result(repeats.repeated_bytes(odd, limit)) == removed(odd_rows())
    assert repeats.repeated_bytes(none, limit).collect() == []


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for n in [1, 2, 3, 7, 8, 9, 64, 65, 300] * 8:
        letters = rng.choice([1, 2, 3, 20])
        data = bytes(rng.randrange(letters) for _ in range(n))
        array = np.frombuffer(data, np.uint8)
        order = repeats.suffix_array(array)
        assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
        shared = repeats.common_prefixes(array, order, 100)
        for a, b, s in zip(order, order[1:], shared[1:]):
            same = next((k for k in range(n) if data[a + k:a + k + 1] != data[b + k:b + k + 1] or b + k >= n or a + k >= n), n)
            assert s == min(same, 100)


def test_lists_merge_by_search():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, rng.integers(0, 30)).astype(np.uint64)) for _ in range(7)]
    values, held = repeats.merge_lists(lists)
    want = Counter(v for x in lists for v in x.tolist())
    assert dict(zip(values.tolist(), held.tolist())) == want and (np.diff(values.astype(np.int64)) > 0).all()


def test_long_texts_run_over_buffers(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * repeats.BUFFER + 1000))
    rows = [(1, long, "a"), (2, long[1000:repeats.BUFFER + 5000], "a"), (3, long[repeats.BUFFER - 150:repeats.BUFFER + 150], "b")]
    assert bytes_result(repeats.repeated_bytes(table(spark, rows))) == removed(rows)


def test_blocks_do_not_depend_on_the_texts_around(spark):
    rng = random.Random(8)
    prose = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(300, 1500))) for _ in range(300)]
    rows = [(k, t + (t[:250] if k % 3 else ""), "a") for k, t in enumerate(prose + prose[::-1] + prose[::2])]
    assert sum(len(t) for _, t, _ in rows) > 2 * repeats.BUFFER

    def prints(texts):
        raw = [t.encode() for t in texts]
        found = repeats.blocks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return Counter(zip(found[2].tolist(), found[3].tolist()))

    assert prints(t for _, t, _ in rows) == sum((prints([t]) for _, t, _ in rows), Counter())
    assert bytes_result(repeats.repeated_bytes(table(spark, rows).repartition(2))) == removed(rows)


# --- turn repair ----------------------------------------------------------------------------------------------

def cheapest(rows):
    """Least cost, then least audit, by a search over (place, state) with a queue."""
    seen, fault = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, said, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return fault, cost, said, "\n".join(lines)
        new = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(queue, (cost + 2, said + "I", i, new, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, said + "D", i + 1, state, lines))
            if fault[i] in ("", "truncated"):
                more = fault[i] == "truncated"
                heapq.heappush(queue, (cost + 2 + more, said + "R", i + 1, new, (*lines, f"{name}:{text}")))
                if role[:1] == new or role[:1] == "s" and state == "":
                    heapq.heappush(queue, (cost + more, said + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def repairs(rows):
    talks = {}
    for conv, turn, role, text in rows:
        held = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, held in talks.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        fault, cost, said, lines = cheapest(held)
        at = [r[0] for r in held if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, said, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


TALK = "conv_id long, turn long, role string, text string, ck string, part int, m long, last boolean, start string"


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, True, "s") for r in rows], TALK)


def talk_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    texts = ["Yes.", "No", "Why?", "", None, "  \t", "so!  ", "…", "a\x00b.", "one two"]
    rows = [(c, rng.choice([None, *range(8)]) if c % 2 else t, rng.choice(roles[:2] if rng.random() < .7 else roles), rng.choice(texts) if rng.random() < .5 else f"t{t}.")
            for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, t, r, "Hm.") for t, r in ((None, "user"), (3, "user"), (None, "user"), (2, None))]
    rows += [(99, t, rng.choice(roles), rng.choice(texts) or f"long {t}") for t in range(400)]  # one conversation over many ranges
    return rows + [(98, 5, "user", "same.")] * 60


@pytest.mark.parametrize("ranges", [None, 1, 25])
def test_turn_repair(spark, ranges):
    rows = talk_rows(3)
    got = turns.repaired(talk_table(spark, rows).repartition(3), ranges).drop("x")
    assert sorted(map(tuple, got.collect()), key=repr) == repairs(rows)


def test_turn_repair_of_nothing(spark):
    assert turns.repaired(talk_table(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turns.repaired(talk_table(spark, [(gone, 0, "user", "Hi.")])).collect()
    assert tuple(got[0]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_chunk_vectors_converge():
    """A chunk that starts from a speculative vector and is fixed up starts like one that knew its end."""
    from collections import namedtuple

    rng = random.Random(8)
    row = namedtuple("row", "initial blank dup trunc m role text")
    for _ in range(300):
        rows = [row(rng.choice("usa "), rng.random() < .1, False, rng.random() < .2, rng.choice([1, 1, 3]), "r", "t") for _ in range(rng.randint(1, 12))]
        old, new = turns.SPECULATIVE, tuple(rng.randint(0, 4) for _ in range(4))
        new = (new[0], min(new[1], 2 + new[2]), min(new[2], 2 + new[3]), min(new[3], 2 + new[2]))
        start = turns.normal(turns.backwards(rows, old)[0])[0]
        assert turns.fix_up(rows, old, new, start) == turns.normal(turns.backwards(rows, new)[0])[0]
