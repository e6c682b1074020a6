"""Chat formatting: minimum-cost role repair, then rendering.

A legal conversation is an optional system turn, then user and assistant turns by turns, ending with
an assistant turn.  Each given turn is kept, relabelled or merged into the turn before it, and empty
turns may be inserted before it or at the end; a dynamic programme over the automaton's states finds
the cheapest repair.  One turn is a small matrix of costs between states, and matrices of successive
turns combine by (min, +) products, so a conversation may be cut anywhere: chunks of turns are worked
out in parallel, a chain over the chunks' matrices gives each chunk the costs it starts from and the
state it must end in, and each chunk then traces its own part back.  A conversation that holds a third
of all turns is many chunks.

The result has a row per given turn: what was done, and the piece of the rendered text it contributes
(tags of inserted turns, its own tags, its text).  Pieces in order are the rendered conversation, which
so never has to fit into one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.session import materialize

#: States: nothing yet, and the role of the open turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
STATES = 4
FAR = 1 << 40
#: Costs of the repairs.
RELABEL, MERGE_SAME, MERGE_OTHER, INSERT = 3, 1, 4, 2
CHUNK = 4096
#: Which roles may open a turn after each state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _opening(state: int, role: int) -> tuple[int, ...] | None:
    """The empty turns to insert so that ``role`` may open after ``state``; None if none do."""
    if role in NEXT[state]:
        return ()
    for first in NEXT[state]:
        if role in NEXT[first]:
            return (first,)
    for first in NEXT[state]:
        for second in NEXT[first]:
            if role in NEXT[second]:
                return (first, second)
    return None


def _steps(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """All steps for a turn labelled ``role`` (START: no legal label): (from, to, cost, action, inserted)."""
    out = []
    for state in range(STATES):
        if state != START:
            same = role == state
            out.append((state, state, MERGE_SAME if same else MERGE_OTHER, "merge", ()))
        for new in (SYSTEM, USER, ASSISTANT):
            inserted = _opening(state, new)
            if inserted is not None:
                out.append((state, new, RELABEL * (new != role) + INSERT * len(inserted),
                            "keep" if new == role else "relabel", inserted))
    return out


def _closing(state: int) -> tuple[int, ...]:
    """Empty turns inserted at the end: an assistant turn must be the last."""
    return () if state in (START, ASSISTANT) else (ASSISTANT,) if state == USER else (USER, ASSISTANT)


# per role and (from, to): the cheapest step, the first of equals
CHOICE = {}
COST = np.full((STATES, STATES, STATES), FAR, dtype=np.int64)
for _role in range(STATES):
    for _step in _steps(_role):
        if _step[2] < COST[_role, _step[0], _step[1]]:
            COST[_role, _step[0], _step[1]] = _step[2]
            CHOICE[_role, _step[0], _step[1]] = _step[3:]
FINAL = np.array([INSERT * len(_closing(s)) for s in range(STATES)], dtype=np.int64)


def role_codes(roles) -> np.ndarray:
    """Automaton roles of role names (case and outer blanks ignored); START where the name is none of them."""
    known = {r: i + 1 for i, r in enumerate(ROLES)}
    return np.array([known.get((r or "").strip().lower(), START) for r in roles], dtype=np.int64)


def forward(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Least costs of the states after each turn, from the costs ``start``: (turns + 1) x states."""
    out = np.empty((len(codes) + 1, STATES), dtype=np.int64)
    out[0] = start
    for i, c in enumerate(codes.tolist()):
        out[i + 1] = np.minimum((out[i][:, None] + COST[c]).min(axis=0), FAR)
    return out


def trace(codes: np.ndarray, costs: np.ndarray, end: int) -> np.ndarray:
    """States before and after each turn on the cheapest path that ends in ``end``; of equally cheap
    ways into a state, that from the lowest state."""
    states = np.empty(len(codes) + 1, dtype=np.int64)
    states[-1] = end
    for i in range(len(codes) - 1, -1, -1):
        states[i] = int((costs[i] + COST[codes[i]][:, states[i + 1]]).argmin())
    return states


def product(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (min, +) product of the turns' matrices, and for each end state the order of the start states
    by which :func:`trace` would prefer their paths where they cost the same (it compares paths from
    their ends); so chunks choose among equals as the whole conversation would."""
    m = np.full((STATES, STATES), FAR, dtype=np.int64)
    paths: dict[tuple[int, int], tuple] = {}
    for s in range(STATES):
        costs = forward(codes, np.where(np.arange(STATES) == s, 0, FAR))
        m[s] = costs[-1]
        for e in range(STATES):
            if m[s, e] < FAR:
                paths[s, e] = tuple(trace(codes, costs, e)[::-1].tolist())
    order = np.full((STATES, STATES), STATES, dtype=np.int64)
    for e in range(STATES):
        for i, s in enumerate(sorted((s for s in range(STATES) if (s, e) in paths), key=lambda s: paths[s, e])):
            order[s, e] = i
    return m, order


ENTRY = np.array([0, FAR, FAR, FAR], dtype=np.int64)
HEAD, TAIL = "<|{}|>\n", "\n<|end|>\n"


def render_turn(code: int, before: int, after: int, text: str, first: bool, last: bool) -> tuple[str, list[str], str]:
    """Action, roles inserted before the turn, and the piece of the rendered text that it contributes."""
    action, inserted = CHOICE[code, before, after]
    name = ROLES[after - 1]
    if action == "merge":
        piece = "\n" + text
    else:
        piece = ("" if first else TAIL) + "".join(HEAD.format(ROLES[s - 1]) + TAIL for s in inserted) + HEAD.format(name) + text
    if last:
        piece += TAIL + "".join(HEAD.format(ROLES[s - 1]) + TAIL for s in _closing(after))
    return action, [ROLES[s - 1] for s in inserted], piece


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk (partition, place // CHUNK) and the place to rows in the order of the conversations."""
    from pyspark import TaskContext
    pid, at = TaskContext.get().partitionId(), 0
    for b in batches:
        place = at + np.arange(b.num_rows, dtype=np.int64)
        at += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array((pid << 32) + place // CHUNK), pa.array(place)], [*b.schema.names, "chunk", "place"])


def _runs(conv: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return list(zip(cuts, cuts[1:], strict=False))


def _edges(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a chunk's first and last conversation: only these may go on in other chunks."""
    pdf = pdf.sort_values("place")
    conv = [None if pd.isna(x) else int(x) for x in pdf["conv_id"]]
    codes, rows = role_codes(pdf["role"]), []
    runs = _runs(conv)
    for a, b in dict.fromkeys([runs[0], runs[-1]]):
        rows.append((conv[a], int(key[0]), int(a == 0), np.stack(product(codes[a:b])).ravel().tolist()))
    return pd.DataFrame(rows, columns=["conv_id", "chunk", "first", "m"])


EDGES = "conv_id long, chunk long, first int, m array<long>"


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's chunks, in order: the costs each starts from, the state it must end in, and
    whether it begins and ends the conversation."""
    pdf = pdf.sort_values("chunk").reset_index(drop=True)
    matrices = [np.array(m, dtype=np.int64).reshape(2, STATES, STATES) for m in pdf["m"]]
    starts = [ENTRY]
    for m, _ in matrices:
        starts.append(np.minimum((starts[-1][:, None] + m).min(axis=0), FAR))
    end = int((starts[-1] + FINAL).argmin())
    ends = [0] * len(matrices)
    for i in range(len(matrices) - 1, -1, -1):
        ends[i] = end
        m, order = matrices[i][:, :, end]
        end = int(np.lexsort((order, starts[i] + m))[0])
    n = len(matrices)
    return pd.DataFrame({"chunk": pdf["chunk"], "first": pdf["first"], "start": [s.tolist() for s in starts[:-1]], "end": ends,
                         "opens": [i == 0 for i in range(n)], "closes": [i == n - 1 for i in range(n)]})


LINKS = "chunk long, first int, start array<long>, end int, opens boolean, closes boolean"
OUT = ("conv_id long, turn long, role string, chunk long, place long, action string, new_role string, "
       "inserted array<string>, piece string")


def _repair(key, pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Repairs and renders one chunk, given the links of its first and last conversation."""
    pdf = pdf.sort_values("place")
    conv = [None if pd.isna(x) else int(x) for x in pdf["conv_id"]]
    codes = role_codes(pdf["role"])
    texts = ["" if t is None else t for t in pdf["text"]]
    link = {int(r.first): r for r in links.itertuples()}
    actions, news, inserted, pieces = [], [], [], []
    for a, b in _runs(conv):
        known = link.get(1) if a == 0 else link.get(0) if b == len(conv) else None
        start = ENTRY if known is None else np.array(known.start, dtype=np.int64)
        costs = forward(codes[a:b], start)
        end = int((costs[-1] + FINAL).argmin()) if known is None else int(known.end)
        states = trace(codes[a:b], costs, end)
        for i in range(a, b):
            first = i == a and (known is None or known.opens)
            last = i == b - 1 and (known is None or known.closes)
            action, put, piece = render_turn(int(codes[i]), int(states[i - a]), int(states[i - a + 1]), texts[i], first, last)
            actions.append(action)
            news.append(ROLES[states[i - a + 1] - 1])
            inserted.append(put)
            pieces.append(piece)
    out = pdf[["conv_id", "turn", "role", "chunk", "place"]].copy()
    out["conv_id"], out["turn"] = out["conv_id"].astype("Int64"), out["turn"].astype("Int64")
    return out.assign(action=actions, new_role=news, inserted=inserted, piece=pieces)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, action (keep, relabel or merge), new_role, inserted (roles of the empty turns
    put before it), piece, and its place in the order (chunk, place) of every row of ``conversations``
    (conv_id, turn, role, text and any other columns).

    Turns go by turn, then role and text (rows that repeat are turns of their own); null ids are one
    conversation; null turns come first; null text is empty; unknown and null roles must be relabelled
    or merged; an empty table gives no rows.
    """
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text")
    turns = materialize(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
                        .mapInArrow(_numbered, "conv_id long, turn long, role string, text string, chunk long, place long"),
                        "chat-turns")
    edges = turns.select("conv_id", "role", "chunk", "place").groupBy("chunk").applyInPandas(_edges, EDGES)
    links = materialize(edges.groupBy("conv_id").applyInPandas(_chain, LINKS), "chat-links")
    return turns.groupBy("chunk").cogroup(links.groupBy("chunk")).applyInPandas(_repair, OUT)


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id and the whole rendered text, for conversations whose text fits into one row."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "place", "piece")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x.piece), "").alias("rendered"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The repaired turns with the pieces of the rendered text."""
    return repaired_turns(conversations).select("conv_id", "turn", "role", "action", "new_role", "inserted", "piece")
