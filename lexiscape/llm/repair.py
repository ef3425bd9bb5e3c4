"""Damaged conversations: faults, and the cheapest edits that give them a sound structure again.

A conversation's rows, in order, are written as a signature: one character a row for the class of its role (by its initial) and its first
fault. The cheapest edits depend on the signature alone. Signatures are sorted, and a task walks its sorted signatures as a
prefix trie, depth first: the dynamic program's layers (four costs: nothing yet, after a system row, after a user's, after an assistant's) lie on a
stack, and what two neighbours have in common is kept, so that a shared prefix is worked out once. At a terminal node
the answer is traced over the stack: nodes that lie on cheapest ways are marked from the end, and the least letter is taken from the start.
Conversations of one signature, in one task, share the answer.

Order and large conversations: rows are dealt by ranges of (conversation, turn, role, hash of the text, place in the input) and written
once with their place, so that a conversation, a turn or a row that stands very often spans many tasks. First
occurrences are a grouped minimum of places, signatures are joined from pieces of 4096 rows; a conversation is one value
only as its signature and its audit (a character a row each). The digest of a repaired conversation is taken over its sorted rows as a
stream, in one task a conversation, since a hash has no parts; memory there doesn't grow with its length.

Nulls: a null conv_id is a conversation; a null turn comes first and counts in no gap; a null role or text is one space.
Equal turns: by role, then by the text's SHA-256. Repeated rows are kept, and damaged alike; all but the first are duplicates.
Texts of any length are hashed whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.session import Scratch

#: Rows whose characters are joined at once: two to this power.
CHUNK = 12
#: Characters of a signature that ranges are cut by; the conversation's id cuts on.
PREFIX = 64

KEEP, REROLE, DELETE, INSERT, OPEN = 0, 1, 2, 5, 5
#: A signature's characters: four role classes (system, user, assistant, other) by four faults (none, blank, duplicate, truncated).
SYMBOLS = "abcdefghijklmnop"
_BLANKS = " \t\n\x0b\x0c\r"
_ENDS = ".!?"

# Costs of a layer: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_SPEAK = (2, 2, 3, 2)  # where a user's or an assistant's row leads from each state
_NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the five kinds of damage, by a checksum of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    t = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return t.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_c")).drop("_c")


def _ordered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with pos, rising by conversation and within it, and h, the text's hash: written once."""
    keys = ["conv_id", "turn", "role", "h", "_n"]
    t = rows.withColumn("h", F.sha2("text", 256)).withColumn("_n", F.monotonically_increasing_id())
    return scratch.table(t.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_n").withColumn("pos", F.monotonically_increasing_id()))


def _symbol(first: Column) -> Column:
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    body = F.btrim("text", F.lit(_BLANKS))
    fault = F.when(body == "", 1).when(~first, 2).when(~F.substring(body, -1, 1).isin(*_ENDS), 3).otherwise(0)
    return F.substring(F.lit(SYMBOLS), role * 4 + fault + 1, F.lit(1))


def signatures(ordered: DataFrame) -> DataFrame:
    """conv_id, sig: a character a row, in order."""
    first = ordered.groupBy("conv_id", "role", "h").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    own = ordered.select("pos", "conv_id", _symbol(F.lit(True)).alias("_new"), _symbol(F.lit(False)).alias("_old")).join(first, "pos", "left")
    own = own.select("conv_id", "pos", F.when(F.col("_first"), F.col("_new")).otherwise(F.col("_old")).alias("x"))
    joined = lambda place: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "x"))), lambda s: s["x"]), "").alias("x")
    piece = own.groupBy("conv_id", F.shiftright("pos", CHUNK).alias("chunk")).agg(joined("pos"))  # few rows
    return piece.groupBy("conv_id").agg(joined("chunk")).withColumnRenamed("x", "sig")


def _after(layer: tuple[int, ...], symbol: str) -> tuple[int, ...]:
    """The layer after a row of this symbol, and what may be inserted behind it."""
    role, fault = divmod(SYMBOLS.index(symbol), 4)
    out = [c + DELETE for c in layer]
    if fault in (0, 3):
        more = OPEN if fault else 0
        for s, c in enumerate(layer):
            to = _SPEAK[s]
            out[to] = min(out[to], c + more + (KEEP if role == to - 1 else REROLE))
        if role == 0:
            out[1] = min(out[1], layer[0] + more + KEEP)
    return _inserted(out)


def _inserted(layer: list[int]) -> tuple[int, ...]:
    for _ in range(2):
        for s in range(4):
            layer[_SPEAK[s]] = min(layer[_SPEAK[s]], layer[s] + INSERT)
    return tuple(layer)


def _moves(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, next state and cost of what a row allows."""
    role, fault = divmod(SYMBOLS.index(symbol), 4)
    yield "D", state, DELETE
    if fault in (0, 3):
        more, to = OPEN if fault else 0, _SPEAK[state]
        if role == 0 and state == 0:
            yield "K", 1, more + KEEP
        if role == to - 1:
            yield "K", to, more + KEEP
        yield "R", to, more + REROLE


def _traced(sig: str, layers: list[tuple[int, ...]]) -> tuple[int, str]:
    """Cost and the ASCII-least of the cheapest audits."""
    n, cost = len(sig), min(layers[-1][0], layers[-1][3])
    alive = [0] * (n + 1)

    def close(i: int) -> None:
        for _ in range(2):
            for s in range(4):
                if alive[i] >> _SPEAK[s] & 1 and layers[i][s] + INSERT == layers[i][_SPEAK[s]]:
                    alive[i] |= 1 << s

    alive[n] = sum(1 << s for s in (0, 3) if layers[n][s] == cost)
    ends = alive[n]
    close(n)
    for i in range(n - 1, -1, -1):
        for s in range(4):
            if any(alive[i + 1] >> to & 1 and layers[i][s] + c == layers[i + 1][to] for _, to, c in _moves(sig[i], s)):
                alive[i] |= 1 << s
        close(i)
    out, i, s = [], 0, 0
    while i < n or not ends >> s & 1:
        ways = [(x, i + 1, to, c) for x, to, c in _moves(sig[i], s)] if i < n else []
        ways.append(("I", i, _SPEAK[s], INSERT))
        x, j, to = min((x, j, to) for x, j, to, c in ways if alive[j] >> to & 1 and layers[i][s] + c == layers[j][to])
        out.append(x)
        i, s = j, to
    return cost, "".join(out)


def solved(sorted_signatures: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature; the layers of what it shares with the one before stay on the stack."""
    layers, before, answer = [_inserted([0, _NEVER, _NEVER, _NEVER])], None, (0, "")
    for sig in sorted_signatures:
        if sig != before:
            shared = 0
            for a, b in zip(before or "", sig):
                if a != b:
                    break
                shared += 1
            del layers[shared + 1 :]
            for symbol in sig[shared:]:
                layers.append(_after(layers[-1], symbol))
            before, answer = sig, _traced(sig, layers)
        yield answer


def audits(signed: DataFrame) -> DataFrame:
    """The rows (with a column sig) and their cost and audit."""
    T.bounded_batches(signed.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def sigs() -> Iterator[str]:
            for b in batches:
                waiting.append(b)
                yield from b.column("sig").to_pylist()

        answers = solved(sigs())
        while (first := next(answers, None)) is not None:
            b = waiting.pop()
            found = [first, *(next(answers) for _ in range(b.num_rows - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*b.schema.names, "cost", "audit"])

    dealt = signed.withColumn("_x", F.substring("sig", 1, PREFIX)).repartitionByRange("_x", "conv_id").drop("_x").sortWithinPartitions("sig")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema)
    return dealt.mapInArrow(each, f"{fields}, cost long, audit string")


class _Digest:
    """SHA-256 of a conversation's repaired lines, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out, self.system, self.sha = audit, 0, 0, 0, hashlib.sha256()

    def _line(self, role: str | None, text: str) -> None:
        role = role if role is not None else ("user", "assistant")[(self.out - self.system) % 2]
        self.sha.update(("\n" if self.out else "").encode() + role.encode() + b":" + text.encode())
        self.out += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._line(None, "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        x = self.audit[self.at]
        self.at += 1
        if x == "K":
            self.system |= not self.out and role[:1] == "s"
            self._line(role, text)
        elif x == "R":
            self._line(None, text)

    def hex(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _digests(ordered: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with repaired_sha256: an answer comes before its conversation's rows, in their order."""
    names = answers.columns
    kinds = dict(answers.dtypes)
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in names if c != "conv_id"]
    rows = ordered.select("conv_id", "pos", "role", "text", *empty).unionByName(answers.select("*", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # the answer at work and its digest
        schema = None

        def batch(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], schema.field(c).type) for i, c in enumerate(names)), pa.array([r[-1] for r in out], pa.string())], names=[*names, "repaired_sha256"])

        for b in batches:
            schema, out = b.schema, []
            for s in T.slices(iter([b])):
                at, roles, texts = s.column("pos").to_pylist(), s.column("role").to_pylist(), s.column("text").to_pylist()
                own = {c: s.column(c).to_pylist() for c in names}
                for i, pos in enumerate(at):
                    if pos < 0:
                        if held:
                            out.append([*held[0], held[1].hex()])
                        held = [[own[c][i] for c in names], _Digest(own["audit"][i])]
                    else:
                        held[1].row(roles[i], texts[i])
            if out:
                yield batch(out)
        if held:
            yield batch([[*held[0], held[1].hex()]])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(each, ", ".join(f"{c} {kinds[c]}" for c in names) + ", repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, a row a conversation of the input."""
    scratch = Scratch(conversations.sparkSession)
    T.bounded_batches(conversations.sparkSession)
    ordered = _ordered(damaged(conversations), scratch)
    turn = ordered.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    t = every
    for more in (signatures(ordered), turn):
        more = more.withColumnRenamed("conv_id", "_k")
        t = t.join(more, F.col("conv_id").eqNullSafe(F.col("_k")), "left").drop("_k")
    t = t.withColumn("sig", F.coalesce("sig", F.lit("")))
    n = F.length("sig")
    roles = F.translate("sig", SYMBOLS, "ssssuuuuaaaaxxxx")
    legal = sum(n - F.length(F.replace(roles, F.lit(x), F.lit(""))) for x in ("su", "ua", "au")) / 2
    faults = [(n - F.length(F.translate("sig", SYMBOLS[i::4], ""))).cast("long").alias(x) for i, x in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    t = t.select("conv_id", "sig", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *faults, (F.greatest(n - 1, F.lit(0)) - legal).cast("long").alias("illegal"))
    answers = scratch.table(audits(t).drop("sig"))
    return _digests(ordered, answers)
