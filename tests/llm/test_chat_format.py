"""Role repair against a search over all repairs, and against a rewrite that sees whole conversations."""

import itertools
import random
import re

import numpy as np
import pytest

from routelens.llm import chat_format as C
from routelens.sources.tables import read_table

SF0001 = "/root/testdata/sf0.001"
TURN = re.compile(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>\n", re.S)


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user" if i % 2 == 0 else "assistant") for i, r in enumerate(body)) and (
        not roles or roles[-1] == "assistant")


def cheapest(codes):
    """The least cost over all sequences of states, by trying them."""
    best = C.FAR
    for states in itertools.product(range(C.STATES), repeat=len(codes)):
        cost, at = 0, C.START
        for c, s in zip(codes, states, strict=True):
            cost += int(C.COST[c, at, s])
            at = s
        best = min(best, cost + int(C.FINAL[at]))
    return best


def path_cost(codes, states):
    return sum(int(C.COST[c, a, b]) for c, a, b in zip(codes, states, states[1:], strict=False)) + int(C.FINAL[states[-1]])


def whole(codes):
    costs = C.forward(codes, C.ENTRY)
    return C.trace(codes, costs, int((costs[-1] + C.FINAL).argmin()))


def test_cheapest_repair():
    rng = random.Random(4)
    for _ in range(150):
        codes = np.array([rng.randrange(4) for _ in range(rng.randint(1, 6))])
        states = whole(codes).tolist()
        assert states[0] == C.START and path_cost(codes, states) == cheapest(codes)


def test_products_combine():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 50)
    a, b = C.product(codes[:20])[0], C.product(codes[20:])[0]
    assert (np.minimum((a[:, :, None] + b[None]).min(axis=1), C.FAR) == C.product(codes)[0]).all()


def plain_render(turns):
    """(role, text) turns of one conversation, rendered without chunks."""
    codes = C.role_codes([r for r, _ in turns])
    states = whole(codes)
    return "".join(C.render_turn(int(c), int(states[i]), int(states[i + 1]), t or "", i == 0, i == len(codes) - 1)[2]
                   for i, (c, (_, t)) in enumerate(zip(codes, turns, strict=True)))


def by_conversation(rows):
    out = {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + (
        tuple((x is not None, x or "") for x in r[2:]))
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2], r[3]))
    return out


@pytest.mark.parametrize("chunk", [3, 4096])
def test_chunks_change_nothing(spark, monkeypatch, chunk):
    """A hot conversation over many chunks, odd roles, nulls, repeats, clashing columns."""
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "User ", "tool", None]
    rows = [(1, i, rng.choice(roles), f"t{i}") for i in range(60)]
    rows += [(c, i, rng.choice(roles), rng.choice(["a", "", None, "b\nc"])) for c in range(2, 12) for i in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "n"), (None, None, "assistant", "m"), (50, 0, "user", "x"), (50, 0, "user", "x"),
             (51, 3, "assistant", "y" * 1_000_000)]
    df = spark.createDataFrame([(*r, "z", 5) for r in rows],
                               "conv_id long, turn long, role string, text string, chunk string, place int")
    small = chunk != C.CHUNK
    if small:
        import inspect
        source = inspect.getsource(C._numbered).replace("CHUNK", str(chunk))
        scope = {"np": np, "pa": C.pa, "Iterator": C.Iterator}
        exec(source.replace("def _numbered", "def cut"), scope)
        monkeypatch.setattr(C, "_numbered", scope["cut"])
    turns = C.repaired_turns(df)
    got = {r["conv_id"]: r["rendered"] for r in C.rendered(turns).collect()}
    want = {c: plain_render(t) for c, t in by_conversation(rows).items()}
    assert got == want
    for text in got.values():
        found = TURN.findall(text)
        assert "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in found) == text
        assert legal([r for r, _ in found])
    assert C.chat_digest(df.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    from routelens.llm.queries import QUERIES
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read_table(spark, SF0001, "conversations").collect()]
    got = QUERIES["op2_chat_format"](spark, SF0001).collect()
    assert len(got) == len(rows)
    pieces = sorted(r["piece"] for r in got)
    want = []
    for turns in by_conversation(rows).values():
        codes = C.role_codes([r for r, _ in turns])
        states = whole(codes)
        want += [C.render_turn(int(c), int(states[i]), int(states[i + 1]), t or "", i == 0, i == len(codes) - 1)[2]
                 for i, (c, (_, t)) in enumerate(zip(codes, turns, strict=True))]
    assert pieces == sorted(want)
