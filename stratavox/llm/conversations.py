"""Conversation structure repair: each distinct sequence of roles and faults is solved once.

The rows of a conversation, in order, become a string of one character a row, its signature; a long
conversation has one signature per CHUNK rows. A signature is solved by memoised recursion on its
halves into a table: for every state of the pattern `(s?(ua)+)?` before and after, the cheapest
edits. Tables of neighbouring chunks combine in the same way, so a conversation of any length is
repaired without being gathered. The edits come back by joins and are replayed on the texts.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, col, dropped, partitions, written, written_by_key
from ..session import ship

#: Rows of one signature; signatures that hold more than one in HOT of all chunks are broadcast, at most HOT of them.
CHUNK, HOT = 256, 128
_SPACE = SPACE.decode()
_ROLES = {"u": "user", "a": "assistant"}
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. What u and a lead to from each.
_STEP = {(0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_STATES, _FINAL = range(4), (0, 3)
_LEGAL = {"su", "ua", "au"}


def _least(*found):
    return min((x for x in found if x is not None), default=None)


def _then(left: list, right: list) -> list:
    """Edits of two stretches in a row. The cheapest and, among equals, ASCII-least whole is made of such parts: of two
    edit strings for the same rows at the same cost none begins the other, since each further edit costs."""
    return [[_least(*((a[0] + b[0], a[1] + b[1]) for mid in _STATES if (a := left[s][mid]) and (b := right[mid][o]))) for o in _STATES] for s in _STATES]


def _inserts() -> list:
    """Up to two inserted turns; a third would come back to a state that was there before."""
    none = [[(0, "") if s == o else None for o in _STATES] for s in _STATES]
    one = [[(5, "I") if o in (_STEP.get((s, "u")), _STEP.get((s, "a"))) else None for o in _STATES] for s in _STATES]
    two = _then(one, one)
    return [[_least(none[s][o], one[s][o], two[s][o]) for o in _STATES] for s in _STATES]


_INSERTS = _inserts()


@functools.cache
def _row(mark: str) -> list:
    """The table of one row, with the turns inserted before it. `d` must go; capitals are truncated; `x` is any other role."""
    out = [[None] * 4 for _ in _STATES]
    for s in _STATES:
        out[s][s] = (2, "D")
        if mark == "d":
            continue
        cut, role = 5 * mark.isupper(), mark.lower()
        if role == "s" and s == 0:
            out[s][1] = _least(out[s][1], (cut, "K"))
        for to in "ua":
            if (o := _STEP.get((s, to))) is not None:
                out[s][o] = _least(out[s][o], (cut, "K") if role == to else (cut + 1, "R"))
    return _then(_INSERTS, out)


@functools.lru_cache(1 << 14)
def _known(signature: str) -> list:
    return _halves(signature)


def _halves(signature: str) -> list:
    if len(signature) == 1:
        return _row(signature)
    mid = len(signature) // 2
    return _then(solve(signature[:mid]), solve(signature[mid:]))


def solve(signature: str) -> list:
    """Table of the cheapest edits of a signature, by state before and after; short ones are remembered."""
    return _known(signature) if len(signature) <= 16 else _halves(signature)


def _packed(table: list) -> str:
    return "|".join("" if x is None else f"{x[0]}:{x[1]}" for row in table for x in row)


def _unpacked(text: str) -> list:
    flat = [None if not x else (int(x.partition(":")[0]), x.partition(":")[2]) for x in text.split("|")]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def best_edits(tables: list) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and per chunk the state before it and its edits; the turns appended at the end belong to the last chunk."""
    # Per state: cost, and the chain of (state before, edits) that led to it.
    reached: list = [(0, None), None, None, None]
    at = [[""] * 4]
    for i, table in enumerate(tables):
        if i == len(tables) - 1:
            table = _then(table, _INSERTS)
        step = []
        for o in _STATES:
            step.append(_least(*((reached[s][0] + x[0], at[-1][s], x[1], s) for s in _STATES if reached[s] is not None and (x := table[s][o]))))
        # Ranks stand for the edits so far: they compare like the strings and stay short.
        order = {k: r for r, k in enumerate(sorted({x[1:3] for x in step if x}, key=lambda k: k))}
        at.append([f"{order[x[1:3]]:02d}" if x else "" for x in step])
        reached = [(x[0], (reached[x[3]][1], x[3], x[2])) if x else None for x in step]
    cost, _, chain = min((reached[s][0], at[-1][s], reached[s][1]) for s in _FINAL if reached[s] is not None)
    parts = []
    while chain is not None:
        chain, state, edits = chain
        parts.append((state, edits))
    return cost, parts[::-1]


def mark(role: str, fault: str) -> str:
    """One row of a signature: `fault` is blank, duplicate, truncated or empty."""
    if fault in ("blank", "duplicate"):
        return "d"
    at = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return at.upper() if fault == "truncated" else at


def fault_of(text: str, again: bool) -> str:
    seen = text.rstrip(_SPACE)
    return "blank" if not seen else "duplicate" if again else "" if seen[-1] in ".!?" else "truncated"


def replay(state: int, edits: str, rows: list[tuple[str, str]]):
    """(edit, role, text) of the repaired turns of a chunk; deleted rows give no turn."""
    rows = iter(rows)
    for e in edits:
        role, text = ("", "") if e == "I" else next(rows)
        if e == "D":
            continue
        to = 1 if e == "K" and role[:1] == "s" else 3 if state == 2 else 2
        if e != "K":
            role = _ROLES["a" if to == 3 else "u"]
        state = to
        yield e, role, text


_CHUNKS = pa.schema([
    ("key", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("several", pa.bool_()), ("signature", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
])
_CHUNKS_DDL = "key string, chunk long, last boolean, several boolean, signature string, roles array<string>, texts array<string>, gaps long, blank long, duplicate long, truncated long, illegal long"


def _chunked(batches):
    """Rows in order to chunks. Figures of a chunk are what its rows add; gaps stand in the last chunk."""
    done: list[dict] = []
    held = 0
    key = chunk = before = low = high = None
    distinct = 0
    now: dict | None = None

    def fresh():
        return {"key": key, "chunk": chunk, "last": False, "several": chunk > 0, "signature": [], "roles": [], "texts": [], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def close(last: bool):
        now["signature"] = "".join(now["signature"])
        now["last"] = last
        now["several"] |= not last
        if last and low is not None:
            now["gaps"] = high - low + 1 - distinct
        done.append(now)

    for batch in batches:
        for k, turn, role, text, nth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if now is not None:
                    close(True)
                key, chunk, before, low, high, distinct = k, 0, None, None, None, 0
                now = fresh()
            elif len(now["roles"]) == CHUNK:
                close(False)
                chunk += 1
                now = fresh()
            fault = fault_of(text, nth > 1)
            if fault:
                now[fault] += 1
            initial = role[:1]
            now["illegal"] += before is not None and before + initial not in _LEGAL
            before = initial
            if turn is not None:
                distinct += turn != high
                low, high = turn if low is None else low, turn
            now["signature"].append(mark(role, fault))
            now["roles"].append(role)
            now["texts"].append(text)
            held += len(text)
            if len(done) >= 1000 or held > 1 << 22 and done:
                yield pa.RecordBatch.from_pylist(done, _CHUNKS)
                done, held = [], 0
    if now is not None:
        close(True)
    yield pa.RecordBatch.from_pylist(done, _CHUNKS)


def _solved(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(solve(x)) for x in batch.column(0).to_pylist()], pa.string())], ["signature", "solution"])


def _conversations(batches):
    """Runs of rows (first column: key, third: last) of one conversation, as lists."""
    rows: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            if row[2]:
                yield rows
                rows = []


def _planned(batches):
    out: list = []

    def flush():
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "chunk", "cost", "state", "edits"])

    for rows in _conversations(batches):
        cost, parts = best_edits([_unpacked(r[3]) for r in rows])
        out += [(r[0], r[1], cost, state, edits) for r, (state, edits) in zip(rows, parts, strict=True)]
        if len(out) >= 5000:
            yield flush()
            out = []
    yield flush()


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")
_REPORT_DDL = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = pa.schema([("key", pa.string()), *((x, pa.int64()) for x in (*_FIGURES, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _reported(batches):
    """Chunks in order, with their edits, to one row per conversation; texts are hashed as they pass."""
    out: list[dict] = []
    digest, sums, edits, first = hashlib.sha256(), dict.fromkeys(_FIGURES, 0), [], True
    for batch in batches:
        for row in batch.to_pylist():
            for x in _FIGURES:
                sums[x] += row[x]
            edits.append(row["edits"])
            for _, role, text in replay(row["state"], row["edits"], zip(row["roles"], row["texts"], strict=True)):
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if row["last"]:
                out.append({"key": row["key"], **sums, "cost": row["cost"], "audit": "".join(edits), "repaired_sha256": digest.hexdigest()})
                digest, sums, edits, first = hashlib.sha256(), dict.fromkeys(_FIGURES, 0), [], True
        yield pa.RecordBatch.from_pylist(out, _REPORT)
        out = []


_ROWS_DDL = "key string, place long, edit string, role string, text string"
_ROWS = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches):
    place = 0
    for batch in batches:
        for row in batch.to_pylist():
            out = []
            for edit, role, text in replay(row["state"], row["edits"], zip(row["roles"], row["texts"], strict=True)):
                out.append({"key": row["key"], "place": place, "edit": edit, "role": role, "text": text})
                place += 1
            if row["last"]:
                place = 0
            yield pa.RecordBatch.from_pylist(out, _ROWS)


def _key(id_col: str) -> Column:
    """A string for every id, null included."""
    return F.coalesce(F.concat(F.lit("="), col(id_col).cast("string")), F.lit(""))


def _with_edits(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The chunks of all conversations, kept by conversation, and the edits of each chunk."""
    ship(rows.sparkSession)
    n = partitions(rows)
    plain = rows.select(
        _key(id_col).alias("key"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    same = Window.partitionBy("key", "role", "text").orderBy("turn")
    ordered = plain.repartition(n, "key").withColumn("nth", F.row_number().over(same)).sortWithinPartitions("key", "turn", "role", "text")
    chunks = written_by_key(ordered.mapInArrow(_chunked, _CHUNKS_DDL), "conversations", "key", n)
    counts = written(chunks.groupBy("signature").agg(F.count("*").alias("n")), "signatures")
    total = counts.agg(F.sum("n")).first()[0] or 0
    solved = written(counts.select("signature").mapInArrow(_solved, "signature string, solution string").join(counts, "signature"), "solutions")
    hot = solved.filter(F.col("n") * HOT > total)
    named = chunks.select("key", "chunk", "last", "signature").join(F.broadcast(hot.select("signature", F.col("solution").alias("hot"))), "signature", "left")
    # Chunks that have their solution already take no part in the second join: their key is made null.
    rest = solved.filter(F.col("n") * HOT <= total).select(F.col("signature").alias("other"), "solution")
    found = named.filter("hot IS NOT NULL").select("key", "chunk", "last", F.col("hot").alias("solution")).unionByName(
        named.filter("hot IS NULL").join(rest, F.col("signature") == F.col("other")).select("key", "chunk", "last", "solution")
    )
    plan = found.repartition(n, "key").sortWithinPartitions("key", "chunk").mapInArrow(_planned, "key string, chunk long, cost long, state long, edits string")
    plan = written(plan, "edits")
    dropped(counts, solved)
    return chunks, plan


def _replayed(chunks: DataFrame, plan: DataFrame, f, ddl: str) -> DataFrame:
    """`f` over the chunks of each conversation in order. Conversations of one chunk lie where they were written; only chunks of longer ones move."""
    one = chunks.filter("NOT several").join(plan.drop("chunk"), "key")
    many = chunks.filter("several").join(plan, ["key", "chunk"]).repartition(partitions(chunks), "key").sortWithinPartitions("key", "chunk")
    names = ["key", "chunk", "last", "roles", "texts", *_FIGURES, "cost", "state", "edits"]
    return one.select(names).mapInArrow(f, ddl).unionByName(many.select(names).mapInArrow(f, ddl))


def repair_report(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: the id column, figures of its faults, cost, audit and the digest of the repaired turns.

    Rows are taken by turn, null turns first, ties by role and text; equal rows are interchangeable.
    A null role or text counts as one space; rows without an id are one conversation. Other columns
    are ignored. An empty table gives no rows. A SHA-256 runs over a conversation in order, so a very
    long one passes through a single task, in chunks; nothing is gathered but its audit, one value.
    """
    chunks, plan = _with_edits(rows, id_col, turn_col, role_col, text_col)
    kind = dict(rows.dtypes)[id_col]
    report = _replayed(chunks, plan, _reported, _REPORT_DDL)
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind)
    return report.select(back.alias(id_col), *_FIGURES, "cost", "audit", "repaired_sha256")


def repair_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns: the id column, place from 0, edit (K, R or I), role and text; nulls, ties and repeated rows as in `repair_report`."""
    chunks, plan = _with_edits(rows, id_col, turn_col, role_col, text_col)
    back = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(dict(rows.dtypes)[id_col])
    return _replayed(chunks, plan, _repaired, _ROWS_DDL).select(back.alias(id_col), "place", "edit", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` of conversations with faults put in by a hash of id and turn; nulls are read as one space, but null ids and turns stay null."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    how = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), how.alias("how"))
        .filter("how <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report = repair_report(damaged(rows)).withColumnRenamed("conv_id", "id")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
            "conv_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in (*_FIGURES, "cost")),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
