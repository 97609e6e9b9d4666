import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerloom.llm import conversation_repair as cr, queries


def plain_fault(text, duplicate):
    solid = re.sub(r"[\x20\x09-\x0D]+", "", text)
    return "blank" if not solid else "duplicate" if duplicate else "" if solid[-1] in ".!?" else "truncated"


def plain_repair(rows):
    """All edit sequences, cheapest first and ASCII-least among those: (cost, audit, rows)."""
    faults, seen = [], set()
    for _, role, text in rows:
        faults.append(plain_fault(text, (role, text) in seen))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if best and (cost, audit) >= best[:2]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = (cost, audit, made)
        if (i, initials, audit) in done or len(initials) > len(rows) + 3:
            continue
        done.add((i, initials, audit))
        ways = [(2, "I", 0, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            extra = 1 if faults[i] == "truncated" else 0
            ways.append((3, "D", 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                ways.append((extra, "K", 1, role, text))
                ways += [(2 + extra, "R", 1, r, text) for r in ("user", "assistant")]
        for more, edit, step, role, text in ways:
            after = initials if role is None else initials + role[:1]
            if role == "" or not re.fullmatch("(s?(ua)*u?)?", after):
                continue
            rest = made if role is None else (*made, (role, text))
            heapq.heappush(heap, (cost + more, audit + edit, i + step, after, rest))
    return best


def taken(rows):
    conversation, seen = cr.Conversation(), set()
    for turn, role, text in rows:
        conversation.row(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    cost, audit = conversation.end()
    return cost, audit, tuple((role, text) for _, _, role, text in conversation.taken)


@pytest.mark.parametrize("settle", [1, 512])
def test_cheapest_and_least_edits(monkeypatch, settle):
    monkeypatch.setattr(cr, "SETTLE", settle)
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", " ", "user", "assistant"]
    for _ in range(150):
        rows = [(k, rng.choice(roles), rng.choice(["a.", "b", "c!", "", "d? ", "e."])) for k in range(rng.randrange(7))]
        assert taken(rows) == plain_repair(rows)


def test_prefixes_are_found_despite_equal_hashes():
    """With a modulus of 3 most hashes are equal; comparisons stay right."""
    rng = random.Random(2)
    for modulus in (3, (1 << 61) - 1):
        ways, texts = cr.Ways(modulus=modulus), [""]
        for _ in range(300):
            parent, edit = rng.randrange(len(texts)), rng.choice("DIKR")
            assert ways.add(parent, edit) == len(texts)
            texts.append(texts[parent] + edit)
        for _ in range(2000):
            x, y = rng.randrange(len(texts)), rng.randrange(len(texts))
            same = [a == b for a, b in zip(texts[x], texts[y], strict=False)]
            assert ways.common(x, y) == (same.index(False) if False in same else len(same))
            assert ways.before(x, y) == (texts[x] < texts[y])
            assert ways.edits(ways.shared([x, y])) == texts[x][: ways.size[ways.shared([x, y])]]


def test_long_conversations_do_not_pile_up():
    conversation, rng = cr.Conversation(), random.Random(3)
    most = 0
    for k in range(4000):
        role = "tool" if rng.random() < 0.1 else ("user", "assistant")[k % 2]
        conversation.row(k, role, f"text {k}.", False)
        most = max(most, len(conversation.waiting))
    assert most < 1000 and len(conversation.taken) > 3000


def plain_summary(conv_rows, original):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest) per conversation."""
    out = []
    for conv in original:
        rows = [r[1:] for r in conv_rows if r[0] == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in rows if r[0] is not None}
        seen, faults = set(), []
        for _, role, text in rows:
            faults.append(plain_fault(text, (role, text) in seen))
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        cost, audit, made = plain_repair(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append(
            (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
             sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
        )
    return sorted(out, key=str)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", None])
            text = rng.choice(["Hello there.", "What?", "Fine!", "not done", None, "", "é.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def test_query_is_the_plain_one(spark, talk, tmp_path):
    schema = "conv_id long, turn long, role string, text string, seen boolean, audit string"
    spark.createDataFrame([(*r, None, None) for r in talk], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_summary(plain_damage(talk), {r[0] for r in talk})


def test_repaired_rows(spark, talk):
    rows = spark.createDataFrame(plain_damage(talk), "conv_id long, turn long, role string, text string")
    digests = {r.conv_id: r for r in cr.repair_conversations(rows).collect()}
    made = {}
    for r in cr.repaired_rows(rows).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(r)
    for conv, said in digests.items():
        here = made.get(conv, [])
        assert [r.place for r in here] == list(range(len(here)))
        assert "".join(r.edit for r in here) == said.audit.replace("D", "")
        text = "\n".join(f"{r.role}:{r.text}" for r in here)
        assert hashlib.sha256(text.encode()).hexdigest() == said.repaired_sha256
        assert all(r.turn is None for r in here if r.edit == "I")


def test_no_rows(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair_conversations(rows).collect() == cr.repaired_rows(rows).collect() == []
