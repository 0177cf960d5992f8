"""Chat formatting with minimum-cost role repair.

A legal conversation is: at most one system turn, then user and assistant in turn, ending with the assistant. A row may be
kept, merged into the turn before it, relabelled, or preceded by an empty turn that the automaton needs. Dynamic programming
over the automaton's states finds the cheapest repair. Steps are min-plus matrices of four states, so a conversation of any
length is solved in segments whose matrices are combined: no task ever holds more than its own share of the rows.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save

MERGE, INSERT, RELABEL = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
#: Ends a turn. It is written with the turn after it, or at the end of the conversation.
END = "\n<|end|>\n"


def role_of(name) -> int:
    """State of a role's name; 0 for null and unknown names, which must be relabelled."""
    return ALIASES.get(str(name).strip().lower(), START) if isinstance(name, str) else START


def moves(state: int, role: int):
    """(cost, next state, empty turns inserted before, merged) of every legal way to take a row of this role."""
    for to in (SYSTEM, USER, ASSISTANT):
        cost = RELABEL if to != role else 0
        if to == SYSTEM:
            if state == START:
                yield cost, to, (), False
        elif to == USER:
            if state != USER:
                yield cost, to, (), False
            else:
                yield cost + INSERT, to, (ASSISTANT,), False
        elif state == USER:
            yield cost, to, (), False
        else:
            yield cost + INSERT, to, (USER,), False
        if to == state:
            yield cost + MERGE, to, (), True


@lru_cache(maxsize=4096)
def options(state: int, role: int):
    return tuple(moves(state, role))


@lru_cache(maxsize=65536)
def solve(roles: tuple[int, ...], entry: int) -> tuple:
    """For each exit state: (cost, decisions) of the cheapest repair from entry; ties go to the option named first."""
    best = {entry: 0}
    back = []
    for role in roles:
        new: dict[int, tuple] = {}
        for state, sofar in best.items():
            for option in options(state, role):
                cost = sofar + option[0]
                if option[1] not in new or cost < new[option[1]][0]:
                    new[option[1]] = (cost, state, option)
        back.append(new)
        best = {s: x[0] for s, x in new.items()}
    out = []
    for exit_ in range(4):
        if exit_ not in best:
            out.append(None)
            continue
        path, s = [], exit_
        for layer in reversed(back):
            _, before, option = layer[s]
            path.append(option)
            s = before
        out.append((best[exit_], tuple(reversed(path))))
    return tuple(out)


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a conversation from this state."""
    return {ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), START: (0, ())}.get(state, (2 * INSERT, (USER, ASSISTANT)))


def final(solved: tuple) -> int:
    """The exit state of the cheapest whole repair."""
    return min((x[0] + closing(s)[0], -s) for s, x in enumerate(solved) if x)[1] * -1


def begun(path: tuple) -> int:
    """Turns that a path begins, inserted ones included."""
    return sum(len(x[2]) + (not x[3]) for x in path)


def fragments(path: tuple, texts: list[str], first: int, last: bool, exit_: int) -> list[tuple]:
    """(action, new role, output turn, empty turns before, rendered) of each row."""
    out, at = [], first - 1
    blank = lambda roles: "".join(f"<|{NAMES[r]}|>\n{END}" for r in roles)
    for (cost, to, inserted, merged), text in zip(path, texts, strict=True):
        head = "\n\n" if merged else END * (at >= 0) + blank(inserted) + f"<|{NAMES[to]}|>\n"
        at += len(inserted) + (not merged)
        same = cost == MERGE * merged + INSERT * len(inserted)
        action = ("merge" if same else "relabel+merge") if merged else ("keep" if same else "relabel")
        out.append((action, NAMES[to], at, len(inserted), head + text))
    if last and out:
        out[-1] = (*out[-1][:4], out[-1][4] + END + blank(closing(exit_)[1]))
    return out


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: key, turn, role, action (keep, relabel, merge, relabel+merge, or orphan without a key), new_role,
    out_turn (from 0), inserted_before, rendered. Rendered fragments in order of (turn, role, text) spell the conversation;
    the last one carries the empty turns that end it.

    Null text is empty; a null or unknown role costs a relabel; rows without a key belong to no conversation; equal turns
    are ordered by role and text, so repeated rows are merged like any others. Only the four named columns are read.
    Rows are range-partitioned by conversation and order. A conversation inside one partition is solved there; the first and
    last of a partition may go on in the next, so their segments are solved for each entry state and joined by matrices.
    """
    src = rows.select(F.col(key).alias("k"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = src.schema["k"].dataType.simpleString()
    keyed = src.where("k is not null")
    cells = ["k", "turn", "role", "text"]
    done = "action string, new_role string, out_turn int, inserted_before int, rendered string"
    names = [c.split()[0] for c in done.split(", ")]
    laid = keyed.repartitionByRange(*([partitions] if partitions else []), *cells).sortWithinPartitions(*cells).withColumn("pid", F.spark_partition_id())
    schema = f"k {kind}, turn bigint, role string, text string, pid int, seq bigint, {done}"

    def emit(part, seq, open_):
        """The rows of whole conversations with their repair, or of an open segment without."""
        out = part.reset_index(drop=True)
        out["seq"] = range(seq, seq + len(out))
        got = [(None,) * len(names)] * len(out)
        if not open_:
            got = []
            for at in out.groupby("k", sort=False).indices.values():
                got += whole(out["role"].to_numpy()[at], out["text"].to_numpy()[at])
            out["text"] = None
        for i, name in enumerate(names):
            out[name] = pd.Series([g[i] for g in got], dtype="Int32" if name in ("out_turn", "inserted_before") else object)
        return out

    def local(batches):
        """Solves the conversations that lie inside the partition; the rows of its first and last one go on unsolved."""
        opening, held, seq = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            batch["turn"] = batch["turn"].astype("Int64")
            if opening is None:
                opening = (batch["k"].iloc[0],)
            if held is None:  # still in the first conversation
                n = int((batch["k"] == opening[0]).to_numpy().cumprod().sum())
                if n:
                    yield emit(batch.iloc[:n], seq, True)
                    seq += n
                batch = batch.iloc[n:]
                if not len(batch):
                    continue
            else:
                batch = pd.concat([held, batch], ignore_index=True)
            n = len(batch) - int((batch["k"] == batch["k"].iloc[-1]).to_numpy()[::-1].cumprod().sum())
            if n:
                yield emit(batch.iloc[:n], seq, False)
                seq += n
            held = batch.iloc[n:]
        if held is not None:
            yield emit(held, seq, True)

    def whole(roles, texts):
        roles = tuple(map(role_of, roles))
        solved = (solve if len(roles) <= 32 else solve.__wrapped__)(roles, START)
        exit_ = final(solved)
        return fragments(solved[exit_][1], list(texts), 0, True, exit_)

    solved = save(laid.mapInPandas(local, schema), "turns")
    closed = solved.where("action is not null").select("k", "turn", "role", *names)
    open_ = solved.where("action is null")

    def matrix(pdf):
        roles = tuple(map(role_of, pdf.sort_values("seq")["role"]))
        out = []
        for entry in range(4):
            for exit_, x in enumerate(solve.__wrapped__(roles, entry)):
                if x:
                    out.append((pdf["k"].iloc[0], int(pdf["pid"].iloc[0]), entry, exit_, x[0], begun(x[1])))
        return pd.DataFrame(out, columns=["k", "pid", "entry", "exit", "cost", "begun"])

    def chain(pdf):
        """The cheapest way through the segments: at most one for each partition."""
        pids = sorted(set(pdf["pid"]))
        at = {p: {} for p in pids}
        for r in pdf.itertuples(index=False):
            at[r.pid][r.entry, r.exit] = (r.cost, r.begun)
        best, back = {START: 0}, []
        for p in pids:
            new = {}
            for (entry, exit_), (cost, n) in sorted(at[p].items()):
                if entry in best and (exit_ not in new or best[entry] + cost < new[exit_][0]):
                    new[exit_] = (best[entry] + cost, entry, n)
            back.append(new)
            best = {s: x[0] for s, x in new.items()}
        s = -min((c + closing(s)[0], -s) for s, c in best.items())[1]
        way = []
        for p, layer in zip(reversed(pids), reversed(back), strict=True):
            way.append((p, layer[s][1], s, layer[s][2]))
            s = layer[s][1]
        out, first = [], 0
        for p, entry, exit_, n in reversed(way):
            out.append((pdf["k"].iloc[0], p, entry, exit_, first, p == pids[-1]))
            first += n
        return pd.DataFrame(out, columns=["k", "pid", "entry", "exit", "first", "last"])

    segments = open_.groupBy("k", "pid").applyInPandas(matrix, f"k {kind}, pid int, entry int, exit int, cost bigint, begun int")
    ways = segments.groupBy("k").applyInPandas(chain, f"k {kind}, pid int, entry int, exit int, first int, last boolean")

    def finish(pdf):
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        entry, exit_, first, last = (pdf[c].iloc[0] for c in ("entry", "exit", "first", "last"))
        path = solve.__wrapped__(tuple(map(role_of, pdf["role"])), int(entry))[int(exit_)][1]
        got = fragments(path, list(pdf["text"]), int(first), bool(last), int(exit_))
        return pd.DataFrame({"k": pdf["k"], "turn": pdf["turn"], "role": pdf["role"], **{c: [g[i] for g in got] for i, c in enumerate(names)}})

    rest = open_.select("k", "turn", "role", "text", "pid", "seq").join(ways, ["k", "pid"]).groupBy("k", "pid").applyInPandas(finish, f"k {kind}, turn bigint, role string, {done}")
    orphans = src.where("k is null").select("k", "turn", "role", F.lit("orphan").alias("action"), F.lit(None).cast("string").alias("new_role"), F.lit(None).cast("int").alias("out_turn"), F.lit(None).cast("int").alias("inserted_before"), F.lit(None).cast("string").alias("rendered"))
    return closed.unionByName(rest).unionByName(orphans).withColumnRenamed("k", key)


def render(rows: DataFrame, key: str = "conv_id", **names) -> DataFrame:
    """key and the whole rendered conversation, for conversations that one row can hold."""
    out = repair(rows, key, **names).where("action <> 'orphan'")
    return out.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_turn", "turn", "role", "rendered"))), lambda x: x["rendered"]), "").alias("conversation"))
