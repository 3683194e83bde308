"""Operator 11: repair of conversations by rank-convergence parallel Viterbi.

A conversation's turns are the stages of a dynamic programme over four states of its role sequence
(nothing yet, after system, after user, after assistant); edits are Keep, Rerole, Delete and Insert.
Turns are range-partitioned in order, so a conversation of any length lies in chunks of bounded size
that many tasks hold.  Costs are computed backwards: every chunk but the last starts from a speculative
vector of costs behind it.  Fix-up passes give each chunk the vector that the chunk behind it has
found; it is walked again, side by side with its old walk, until both vectors differ by a constant only:
all in front of that turn stays as it was.  When no vector changes any more, the least audit is
traced forwards through the stitched vectors, chunk by chunk, from speculative states that the same
kind of passes mend.  Conversations of one chunk need no pass at all.

Faults: blank turns (no character but white space), duplicates (role and text met earlier) and truncated
ones (the last such character is none of `.!?`); the first of them counts.  Rows are in order of turn
(nulls first), and of role and text where turns are equal.

Defined cases: null roles and texts are one space; null conversation ids make one conversation; null
turns come first and take no part in gaps; equal rows are one row with a number of copies, so a row
repeated any number of times is never dealt to one task uncounted; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, join_classes, save

#: Costs of edits, and what a truncated turn costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of a chunk.
ROWS, CHARACTERS = 1024, 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs behind the last turn: nothing and a finished answer are legal ends.
END = (0, 2 * INSERT, INSERT, 0)
#: A turn's symbol: its role (0 to 3: system, user, assistant, other), TRUNCATED_BIT, or GONE for what must be deleted.
TRUNCATED_BIT, GONE = 4, 8
ROLES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}


def _spoken(state: int) -> int:
    """The state after an inserted or reroled turn: who has to speak is never in doubt."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: int) -> int | None:
    """The state after a turn of this role that is kept as it is."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return None if state == USER else USER
    return ASSISTANT if role == 2 and state == USER else None


@lru_cache(maxsize=1 << 16)
def _costs(behind: tuple, symbol: int) -> tuple[tuple, tuple]:
    """Costs from each state before a turn, from those behind it; and of these, what is told of a chunk: differences alone."""
    taken, late = [], TRUNCATED if symbol & TRUNCATED_BIT else 0
    for state in range(4):
        best = DELETE + behind[state]
        if symbol != GONE:
            best = min(best, REROLE + late + behind[_spoken(state)])
            if (after := _kept(state, symbol & 3)) is not None:
                best = min(best, late + behind[after])
        taken.append(best)
    user, assistant = taken[USER], taken[ASSISTANT]
    closed = [0, 0, min(user, INSERT + assistant), min(assistant, INSERT + user)]
    closed[START], closed[SYSTEM] = (min(taken[k], INSERT + closed[USER]) for k in (START, SYSTEM))
    return tuple(closed), level(closed)


def level(costs) -> tuple:
    """Costs up to a constant."""
    least = min(costs)
    return tuple(x - least for x in costs)


@lru_cache(maxsize=1 << 16)
def _edits(state: int, behind: tuple, symbol: int) -> tuple[str, int, int]:
    """The least edits at a turn among the cheapest ones, the state after it, and their cost."""
    costs, _ = _costs(behind, symbol)
    late, done, spent = TRUNCATED if symbol & TRUNCATED_BIT else 0, "", 0
    while True:
        if DELETE + behind[state] == costs[state]:
            return done + "D", state, spent + DELETE
        if INSERT + costs[_spoken(state)] == costs[state]:
            done, spent, state = done + "I", spent + INSERT, _spoken(state)
            continue
        after = _kept(state, symbol & 3)
        if after is not None and late + behind[after] == costs[state]:
            return done + "K", after, spent + late
        return done + "R", _spoken(state), spent + REROLE + late


def vector_before(symbols: bytes, behind: tuple) -> tuple:
    for symbol in reversed(symbols):
        behind = _costs(behind, symbol)[1]
    return behind


def vector_mended(symbols: bytes, was: tuple, now: tuple, result: tuple) -> tuple:
    """`vector_before` of `now`, knowing that of `was`: where both walks agree up to a constant, the rest is known."""
    for symbol in reversed(symbols):
        if was == now:
            return result
        was, now = _costs(was, symbol)[1], _costs(now, symbol)[1]
    return result if was == now else now


def vectors(symbols: bytes, behind: tuple) -> list[tuple]:
    """The costs behind each turn, up to constants."""
    out = [behind]
    for symbol in reversed(symbols[1:]):
        out.append(_costs(out[-1], symbol)[1])
    return out[::-1]


def state_after(symbols: bytes, behind: tuple, state: int) -> int:
    for costs, symbol in zip(vectors(symbols, behind), symbols):
        state = _edits(state, costs, symbol)[1]
    return state


def state_mended(symbols: bytes, behind: tuple, was: int, now: int, result: int) -> int:
    """`state_after` of `now`, knowing that of `was`: where both traces meet, the rest is known."""
    for costs, symbol in zip(vectors(symbols, behind), symbols):
        if was == now:
            return result
        was, now = (_edits(x, costs, symbol)[1] for x in (was, now))
    return result if was == now else now


# --- chunks --------------------------------------------------------------------------------------

CONV = ["none", "conv"]
CHUNK = [*CONV, "part", "piece"]
CHUNKS = "none boolean, conv long, part int, piece int, turns array<long>, roles array<string>, texts array<string>, copies array<long>, digests array<binary>, symbols binary"


def _symbol(role: str, text: str) -> int:
    said = text.strip(SPACE)
    return GONE if not said else ROLES.get(role[:1], 3) | (0 if said[-1] in ".!?" else TRUNCATED_BIT)


def _equal_rows(batches):
    """Rows of a batch that are equal in all columns become one, with their copies added up."""
    for batch in batches:
        names = ["none", "conv", "known", "turn", "role", "text"]
        some = pa.Table.from_batches([batch]).group_by(names).aggregate([("copies", "sum")])
        yield from some.rename_columns([*names, "copies"]).to_batches()


def cut_chunks(turns: DataFrame, rows: int = ROWS, characters: int = CHARACTERS) -> DataFrame:
    """Chunks of turns (conv_id, turn, role, text, and `copies` if there) in order, saved.

    A partition's rows of one conversation are cut after so many rows or characters; (part, piece) is the order of chunks.
    """
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    plain = turns.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies"),
    )
    order = ["none", "conv", "known", "turn", "role", "text"]
    ordered = plain.mapInArrow(_equal_rows, plain.schema).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, piece, open_, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def chunk():
            turn, role, text, n = (list(x) for x in zip(*held))
            digests = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(role, text)]
            return {"none": open_[0], "conv": open_[1], "part": part, "piece": piece, "turns": turn, "roles": role, "texts": text, "copies": n, "digests": digests, "symbols": bytes(map(_symbol, role, text))}

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        out, weight = [], 0
        for batch in batches:
            for none, conv, known, turn, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                row = (turn if known else None, role, text)
                if held and open_ == (none, conv) and held[-1][:3] == row:
                    held[-1] = (*row, held[-1][3] + n)
                    continue
                if held and (open_ != (none, conv) or len(held) >= rows or size >= characters):
                    out.append(chunk())
                    weight += size + 100 * len(held)
                    piece, held, size = piece + 1, [], 0
                    if weight > 4 << 20:
                        yield batch_of(out)
                        out, weight = [], 0
                open_ = (none, conv)
                held.append((*row, n))
                size += len(text)
        if held:
            out.append(chunk())
        if out:
            yield batch_of(out)

    string, long = pa.string(), pa.int64()
    schema = pa.schema(
        [("none", pa.bool_()), ("conv", long), ("part", pa.int32()), ("piece", pa.int32()), ("turns", pa.list_(long)), ("roles", pa.list_(string)), ("texts", pa.list_(string))]
        + [("copies", pa.list_(long)), ("digests", pa.list_(pa.binary())), ("symbols", pa.binary())]
    )
    return save(ordered.mapInArrow(run, CHUNKS), "chunks")


def repeated_turns(chunks: DataFrame, rows: int) -> DataFrame:
    """(chunk, repeats): places in each chunk of the turns whose role and text the conversation has met earlier."""
    each = chunks.select(*CHUNK, F.posexplode("digests").alias("at", "digest"))
    place = F.struct("part", "piece", "at")
    classes = each.groupBy(*CONV, "digest").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1")
    known = join_classes(each, classes, [*CONV, "digest"], "size", rows)
    return known.where(place > F.col("first")).groupBy(*CHUNK).agg(F.sort_array(F.collect_list("at")).alias("repeats"))


# --- fix-up passes -------------------------------------------------------------------------------

VECTOR = "array<int>"


def _walked(table: DataFrame, walk, result: str) -> DataFrame:
    """`table` with the column `found` that `walk` makes of each row."""

    def run(batches):
        for batch in batches:
            found = [walk(r) for r in batch.to_pylist()]
            yield batch.append_column("found", pa.array(found, pa.list_(pa.int32()) if result == VECTOR else pa.int32()))

    return table.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in table.dtypes) + f", found {result}")


def settle(table: DataFrame, step: int, result: str, first, again) -> DataFrame:
    """Passes over chunks numbered `idx` until every chunk's `given` is what the chunk `step` further has `found`.

    `first(row)` walks a chunk from its speculative `given`; `again(row)` walks it from `offered`, knowing what it found before.
    """
    now = save(_walked(table, first, result), "pass")
    while True:
        offered = now.select(*CONV, (F.col("idx") - step).cast("int").alias("idx"), F.col("found").alias("offered"))
        both = now.join(offered, [*CONV, "idx"], "left").withColumn("offered", F.coalesce("offered", "given"))
        if both.where("given <> offered").isEmpty():
            return now
        stale = both.where("given <> offered").withColumnRenamed("found", "before")
        mended = _walked(stale, again, result).drop("before", "given").withColumnRenamed("offered", "given")
        now = save(both.where("given = offered").drop("offered").unionByName(mended), "pass")


def boundaries(chunks: DataFrame, repeats: DataFrame) -> DataFrame:
    """(chunk, behind, state) of every chunk of the conversations that have several: the costs behind it and the state before it."""
    heads = chunks.select(*CHUNK)
    several = heads.groupBy(*CONV).agg(F.count("*").cast("int").alias("n")).where("n > 1")
    # Keys alone are numbered: a row for a thousand turns.
    numbered = heads.join(several, CONV).withColumn("idx", F.row_number().over(Window.partitionBy(*CONV).orderBy("part", "piece")) - 1)
    light = numbered.join(chunks.select(*CHUNK, "symbols"), CHUNK).join(repeats, CHUNK, "left")
    light = save(light.select(*CHUNK, "idx", "n", "symbols", "repeats"), "chunk-symbols")
    symbols = lambda r: _marked(r["symbols"], r["repeats"])
    end, open_ = F.array(*map(F.lit, END)), F.array(*[F.lit(0)] * 4)
    back = settle(
        light.withColumn("given", F.when(F.col("idx") == F.col("n") - 1, end).otherwise(open_)),
        1, VECTOR,
        lambda r: list(vector_before(symbols(r), tuple(r["given"]))),
        lambda r: list(vector_mended(symbols(r), tuple(r["given"]), tuple(r["offered"]), tuple(r["before"]))),
    )
    ahead = back.select(*CHUNK, "idx", "n", "symbols", "repeats", F.col("given").alias("behind"), F.when(F.col("idx") == 0, START).otherwise(ASSISTANT).alias("given"))
    forth = settle(
        ahead, -1, "int",
        lambda r: state_after(symbols(r), tuple(r["behind"]), r["given"]),
        lambda r: state_mended(symbols(r), tuple(r["behind"]), r["given"], r["offered"], r["before"]),
    )
    return forth.select(*CHUNK, "behind", F.col("given").alias("state"), (F.col("idx") == F.col("n") - 1).alias("last"))


def _marked(symbols: bytes, gone) -> bytes:
    if not gone:
        return bytes(symbols)
    out = bytearray(symbols)
    for k in gone:
        out[k] = GONE
    return bytes(out)


# --- traces --------------------------------------------------------------------------------------

EDITED = (
    "none boolean, conv long, part int, piece int, audit string, roles array<string>, texts array<string>, cost long, blank long, duplicate long, truncated long, illegal long,"
    " first_role string, last_role string, low long, high long, distinct_turns long"
)


def _trace(r: dict) -> dict:
    """Edits, repaired turns and counts of a chunk."""
    again = set(r["repeats"] or ())
    symbols = _marked(r["symbols"], again)
    state, audit, roles, texts, cost = r["state"], [], [], [], 0

    def speak(text: str) -> None:
        nonlocal state
        state = _spoken(state)
        roles.append("assistant" if state == ASSISTANT else "user")
        texts.append(text)

    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for k, (costs, symbol) in enumerate(zip(vectors(symbols, tuple(r["behind"])), symbols)):
        edits, after, spent = _edits(state, costs, symbol)
        for edit in edits:
            if edit == "I":
                speak("")
            elif edit == "R":
                speak(r["texts"][k])
            elif edit == "K":
                roles.append(r["roles"][k])
                texts.append(r["texts"][k])
        state, n = after, r["copies"][k]
        audit.append(edits + "D" * (n - 1))
        cost += spent + DELETE * (n - 1)
        blank = r["symbols"][k] == GONE
        counts["blank"] += n if blank else 0
        counts["duplicate"] += 0 if blank else n if k in again else n - 1
        counts["truncated"] += bool(symbol != GONE and symbol & TRUNCATED_BIT)
    if r["last"]:
        for _ in range(END[state] // INSERT):
            speak("")
            audit.append("I")
            cost += INSERT
    initials = [x[:1] for x in r["roles"]]
    turns = [t for t in r["turns"] if t is not None]
    return {c: r[c] for c in CHUNK} | counts | {
        "audit": "".join(audit), "roles": roles, "texts": texts, "cost": cost,
        "illegal": sum(r["copies"]) - len(initials) + sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])),
        "first_role": initials[0], "last_role": initials[-1],
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct_turns": len(set(turns)),
    }


def repair_chunks(turns: DataFrame, rows: int = ROWS, characters: int = CHARACTERS) -> DataFrame:
    """Each chunk with its audit, its turns as repaired (`roles`, `texts`) and its counts; chunks of a conversation are in order of part and piece."""
    chunks = cut_chunks(turns, rows, characters)
    total = chunks.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
    repeats = save(repeated_turns(chunks, total), "repeats")
    bounds = boundaries(chunks, repeats)
    # Chunks with a repeat or a neighbour are few; the others need nothing from elsewhere.
    known = repeats.join(bounds, CHUNK, "full_outer")
    end = F.array(*map(F.lit, END))
    ready = chunks.drop("digests").join(known, CHUNK, "left").withColumns(
        {"behind": F.coalesce("behind", end), "state": F.coalesce("state", F.lit(START)), "last": F.coalesce("last", F.lit(True))}
    )

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([_trace(r) for r in batch.slice(at, 64).to_pylist()], schema=schema)

    strings, long = pa.list_(pa.string()), pa.int64()
    schema = pa.schema(
        [("none", pa.bool_()), ("conv", long), ("part", pa.int32()), ("piece", pa.int32()), ("audit", pa.string()), ("roles", strings), ("texts", strings)]
        + [(c, long) for c in ("cost", "blank", "duplicate", "truncated", "illegal")] + [("first_role", pa.string()), ("last_role", pa.string())]
        + [(c, long) for c in ("low", "high", "distinct_turns")]
    )
    return ready.mapInArrow(run, EDITED)


def repaired_turns(edited: DataFrame) -> DataFrame:
    """(conv_id, part, piece, place, role, text): the repaired conversations, in order of part, piece and place."""
    turns = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")
    return edited.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "part", "piece", turns).select("conv_id", "part", "piece", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


REPORT = "none boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def conversation_report(edited: DataFrame) -> DataFrame:
    """One row for each conversation with rows: its counts, audit and the digest of its repaired lines.

    Chunks of a conversation stream through one task in order, which holds sums, the audit and the state of the digest.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    slim = edited.withColumns({"lines": F.when(F.size("roles") > 0, lines)}).drop("roles", "texts")
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        now = None

        def result(c):
            gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["distinct_turns"]
            return {"none": c["none"], "conv": c["conv"], "gaps": gaps, "audit": "".join(c["audit"]), "repaired_sha256": c["sha"].hexdigest()} | {k: c[k] for k in sums}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or (now["none"], now["conv"]) != (r["none"], r["conv"]):
                    if now is not None:
                        out.append(result(now))
                    now = {**r, "audit": [r["audit"]], "sha": hashlib.sha256((r["lines"] or "").encode()), "some": r["lines"] is not None}
                    continue
                for k in sums:
                    now[k] += r[k]
                now["illegal"] += now["last_role"] + r["first_role"] not in LEGAL
                now["distinct_turns"] += r["distinct_turns"] - (now["high"] is not None and now["high"] == r["low"])
                now["last_role"] = r["last_role"]
                now["low"] = r["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if r["high"] is None else r["high"]
                now["audit"].append(r["audit"])
                if r["lines"] is not None:
                    now["sha"].update((("\n" if now["some"] else "") + r["lines"]).encode())
                    now["some"] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([result(now)], schema=schema)

    long = pa.int64()
    schema = pa.schema([("none", pa.bool_()), ("conv", long), *((c, long) for c in ("gaps", *sums[:4], "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return slim.repartition(*CONV).sortWithinPartitions(*CHUNK).mapInArrow(run, REPORT)


def repair_report(every: DataFrame, edited: DataFrame) -> DataFrame:
    """The report of every conversation id of `every`; those without rows have zeros, no audit and the digest of nothing."""
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "conv_id")
    rows = ids.join(conversation_report(edited), CONV, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text, copies) with faults put in by the checksum of their place: a fixed share of rows each way."""
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    how = (F.crc32(place) % 20).alias("how")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), how).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("copies"))
