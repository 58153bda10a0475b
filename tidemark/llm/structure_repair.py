"""Conversation structure repair: error-correcting Earley parsing of the roles, with the cheapest edits as the repair.

The grammar of role initials is ``(s?(ua)+)?``, left-linear, so that a chart column has a fixed number of items. Its
terminals read a row by productions with a cost and a letter: Keep (0, the row has that initial), Rerole to user or
assistant (2), Delete (3) anywhere, Insert an empty user or assistant row anywhere (2); an undeleted truncated row adds 1; a
blank or duplicate row can only be deleted. Every chart item retains the least (cost, audit) of its derivations, where the
audit is the edits' letters in order and ties go to the ASCII-least. Audits of equal cost that have read equally many rows
are never prefixes of each other (an insertion costs), so a least audit stays least whatever follows.

Rows of a conversation stand by turn (nulls first), then role, then text; equal rows are counted first and follow each other.
Each row's first fault counts: *blank* (no character but ASCII blanks), *duplicate* (role and text stood earlier in the
conversation), *truncated* (its last other character is none of ``.!?``).

1. Rows are grouped, range-partitioned by conversation and order, and written as pieces of at most ``PIECE`` rows of one
   conversation. A conversation that one partition holds whole in one piece is repaired there.
2. Of conversations in several pieces, whatever their number of rows, each piece tells its distinct (role, text) by a
   128-bit hash, and a grouping finds the piece that has each first. Each piece is then parsed from every nonterminal that may
   stand before it: a table of least (cost, audit) by entry and exit.
3. The tables of a conversation, streamed in order, give the cheapest path; pieces are repaired by the edits on that path.

Memory of a task is a piece and one conversation's audit (a byte a row), which is a value of the result. The digest of a
repaired conversation is one hash over all its text in order, so its pieces pass one task, one at a time.

Null roles and texts are one space; a null conversation is one conversation; rows that stand 0 times only name their conversation
(all its rows may be gone: zeros, an empty audit, an empty string's hash); an empty table gives no row; further columns
are not read. Costs and gaps beyond a long count as the largest long.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep_plan_short, with_small_batches

#: Rows of a piece, and characters after which it is cut.
PIECE, PIECE_CHARS = 512, 1 << 22
#: Head and body of the productions; what is no head is a terminal.
GRAMMAR = (
    ("Conversation", ("Start",)),
    ("Conversation", ("Closed",)),
    ("Start", ()),
    ("Start", ("Start", "deleted")),
    ("System", ("Start", "s")),
    ("System", ("System", "deleted")),
    ("Opened", ("Start", "u")),
    ("Opened", ("System", "u")),
    ("Opened", ("Closed", "u")),
    ("Opened", ("Opened", "deleted")),
    ("Closed", ("Opened", "a")),
    ("Closed", ("Closed", "deleted")),
)
STATES = ("Start", "System", "Opened", "Closed")
ACCEPTED = ("Start", "Closed")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FULL_ROLE = {"u": "user", "a": "assistant"}
LONGEST = 2**63 - 1

_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_BLANKS = " \t\n\x0b\x0c\r"

PIECE_SCHEMA = "conv_id long, part long, whole boolean, packed binary"
COUNTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, least_turn long, most_turn long"
REPAIRED_SCHEMA = f"conv_id long, piece long, whole boolean, messages array<struct<role: string, text: string>>, audit string, cost long, {COUNTS}"
PARSED_SCHEMA = f"conv_id long, piece long, packed binary, tokens binary, paths binary, {COUNTS}"
REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

# A token is (initial or "" where none of s, u, a; truncated; must be deleted; times in a row). Weights are (cost, audit).
Token = tuple[str, bool, bool, int]
Weight = tuple[int, str]


def _reads(terminal: str, token: Token) -> Weight | None:
    """Cost and letter of reading a row as a terminal."""
    initial, truncated, doomed, times = token
    if terminal == "deleted":
        return DELETE * times, "D" * times
    if doomed:
        return None
    more = TRUNCATED * truncated
    if initial == terminal:
        return more, "K"
    return (REROLE + more, "R") if terminal in FULL_ROLE else None


def parse(tokens: tuple[Token, ...], entry: str = "Start") -> dict[str, Weight]:
    """Least (cost, audit) of the whole input by nonterminal, if ``entry`` has been recognised before it."""
    rules = [r for r in GRAMMAR if r[1]] + [(entry, ())]
    by_head: dict[str, list[int]] = {}
    for k, (head, _) in enumerate(rules):
        by_head.setdefault(head, []).append(k)
    #: By column and nonterminal, the items that wait for it and their weights.
    waiting: list[dict[str, dict[tuple[int, int, int], Weight]]] = []
    incoming: list[tuple[Weight, tuple[int, int, int]]] = [((0, ""), (k, 0, 0)) for head in ("Conversation", *STATES) for k in by_head.get(head, ())]
    done: dict[tuple[str, int], Weight] = {}
    for at in range(len(tokens) + 1):
        best: dict[tuple[int, int, int], Weight] = {}
        done, agenda, onward = {}, [], []
        here: dict[str, dict[tuple[int, int, int], Weight]] = {}
        waiting.append(here)

        def offer(weight: Weight, item: tuple[int, int, int], best=best, agenda=agenda) -> None:
            if item not in best or weight < best[item]:
                best[item] = weight
                heapq.heappush(agenda, (weight, item))

        for weight, item in incoming:
            offer(weight, item)
        while agenda:
            weight, item = heapq.heappop(agenda)
            if weight != best[item]:
                continue
            rule, dot, origin = item
            head, body = rules[rule]
            if dot == len(body):  # complete
                if (head, origin) in done and done[head, origin] <= weight:
                    continue
                done[head, origin] = weight
                for (r, d, o), before in list(waiting[origin].get(head, {}).items()):
                    offer((before[0] + weight[0], before[1] + weight[1]), (r, d + 1, o))
            elif body[dot] in by_head:  # predict
                here.setdefault(body[dot], {})[item] = weight
                for k in by_head[body[dot]]:
                    offer((0, ""), (k, 0, at))
                if (body[dot], at) in done:
                    ready = done[body[dot], at]
                    offer((weight[0] + ready[0], weight[1] + ready[1]), (rule, dot + 1, origin))
            else:  # insert, or scan the next row
                if body[dot] in FULL_ROLE:
                    offer((weight[0] + INSERT, weight[1] + "I"), (rule, dot + 1, origin))
                onward.append(item)
        incoming = []
        if at < len(tokens):
            for item in onward:
                read = _reads(rules[item[0]][1][item[1]], tokens[at])
                if read is not None:
                    weight = best[item]
                    incoming.append(((weight[0] + read[0], weight[1] + read[1]), (item[0], item[1] + 1, item[2])))
    return {head: weight for (head, origin), weight in done.items() if origin == 0}


#: Most conversations are short and alike in their tokens.
_parsed = lru_cache(1 << 14)(parse)


def tokens_of(rows: list[tuple], new: list[bool]) -> tuple[tuple[Token, ...], dict]:
    """Tokens and counts of rows (turn, role, text, n); ``new``: whether role and text didn't stand earlier."""
    tokens: list[Token] = []
    counts = {"n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "last": None, "turns": 0, "least_turn": None, "most_turn": None}

    def add(token: Token) -> None:
        if token[2] and tokens and tokens[-1][2]:
            tokens[-1] = (*tokens[-1][:3], tokens[-1][3] + token[3])
        else:
            tokens.append(token)

    for (turn, role, text, n), is_new in zip(rows, new, strict=True):
        initial = role[:1]
        counts["n_rows"] += n
        counts["illegal"] += (n - 1) + (counts["last"] is not None and counts["last"] + initial not in ("su", "ua", "au"))
        counts["first"] = initial if counts["first"] is None else counts["first"]
        counts["last"] = initial
        if turn is not None and turn != counts["most_turn"]:
            counts["turns"] += 1
            counts["least_turn"], counts["most_turn"] = turn if counts["least_turn"] is None else counts["least_turn"], turn
        if not _SEEN.search(text):
            counts["blank"] += n
            add(("", False, True, n))
            continue
        copies = n - is_new
        counts["duplicate"] += copies
        if is_new:
            truncated = text.rstrip(_BLANKS)[-1] not in ".!?"
            counts["truncated"] += truncated
            add((initial if initial in "sua" else "", truncated, False, 1))
        if copies:
            add(("", False, True, copies))
    return tuple(tokens), counts


def repaired(rows: list[tuple], tokens: tuple[Token, ...], audit: str, entry: str = "Start") -> list[tuple[str, str]]:
    """(role, text) of the messages that an audit leaves, where ``entry`` stands before it."""
    out = []
    wanted = {"Start": "u", "System": "u", "Closed": "u", "Opened": "a"}[entry]
    each = ((role, text) for _, role, text, n in rows for _ in range(n))
    for letter in audit:
        if letter == "I":
            out.append((FULL_ROLE[wanted], ""))
        else:
            role, text = next(each)
            if letter == "D":
                continue
            if letter == "K" and role[:1] == "s":
                out.append((role, text))
                continue
            out.append((role if letter == "K" else FULL_ROLE[wanted], text))
        wanted = "a" if wanted == "u" else "u"
    return out


def _pickled(x: object) -> bytes:
    return zstandard.compress(pickle.dumps(x, protocol=5), 1)


def _loaded(blob: bytes) -> object:
    """Only what this module has written is read."""
    return pickle.loads(zstandard.decompress(blob))


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces of at most ``most`` rows; the first and last conversation of a partition may go on in its neighbours."""
    part, made = TaskContext.get().partitionId() << 32, 0
    conv, rows, chars, first_conv, cut = None, [], 0, True, False

    def piece(whole: bool) -> pa.RecordBatch:
        nonlocal rows, chars, made
        made += 1
        arrays = [pa.array([conv], pa.int64()), pa.array([part + made], pa.int64()), pa.array([whole]), pa.array([_pickled(rows)], pa.binary())]
        rows, chars = [], 0
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "whole", "packed"])

    begun = False
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for conv_id, turn, role, text, n in zip(*(some.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n")), strict=True):
                if begun and conv_id != conv:
                    yield piece(not first_conv and not cut)
                    first_conv = cut = False
                elif begun and (len(rows) >= most or chars >= PIECE_CHARS):
                    yield piece(False)
                    cut = True
                begun, conv = True, conv_id
                if n:
                    rows.append((turn, role, text, n))
                    chars += len(text) + len(role)
    if begun:
        yield piece(False)


def _fresh(rows: list[tuple], allowed: set[bytes] | None = None) -> list[bool]:
    """Whether each row's role and text stand first here (and, of a longer conversation, are ``allowed`` to)."""
    seen, out = set(), []
    for _, role, text, _ in rows:
        key = (role, text)
        out.append(key not in seen and (allowed is None or _key(role, text) in allowed))
        seen.add(key)
    return out


def _key(role: str, text: str) -> bytes:
    raw = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<struct<role: string, text: string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in re.split(r", (?![^<]*>)", ddl)])


def _messages(pairs: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in pairs]


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(REPAIRED_SCHEMA)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(at, 64).to_pylist():
                rows = _loaded(row["packed"])
                tokens, counts = tokens_of(rows, _fresh(rows))
                ends = _parsed(tokens)
                cost, audit = min(ends[s] for s in ACCEPTED if s in ends)
                out.append({"conv_id": row["conv_id"], "piece": row["part"], "whole": True, "messages": _messages(repaired(rows, tokens, audit)), "audit": audit, "cost": min(cost, LONGEST), **counts})
            yield _arrow(out, schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["conv_id", "part", "packed"]).to_pylist():
            keys = list({_key(role, text) for _, role, text, _ in _loaded(row["packed"])})
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([row["conv_id"]] * n, pa.int64()), pa.array([row["part"]] * n, pa.int64()), pa.array(keys, pa.binary())], ["conv_id", "part", "key"])


def _parse_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(PARSED_SCHEMA)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            rows = _loaded(row["packed"])
            tokens, counts = tokens_of(rows, _fresh(rows, set(row["keys"] or ())))
            paths = {entry: {s: w for s, w in _parsed(tokens, entry).items() if s in STATES} for entry in STATES}
            yield _arrow([{"conv_id": row["conv_id"], "piece": row["part"], "packed": row["packed"], "tokens": _pickled(tokens), "paths": _pickled(paths), **counts}], schema)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, by conversation: the states before each piece on the cheapest path."""
    schema = _schema("conv_id long, piece long, entry string, left string")
    conv, begun = None, False
    pieces: list[int] = []
    # By state the weight and the states so far, as a chain (last state, chain before).
    so_far: dict[str, tuple[int, tuple, tuple]] = {}

    def audit_of(chain: tuple) -> str:
        parts = []
        while chain:
            parts.append(chain[0])
            chain = chain[1]
        return "".join(reversed(parts))

    def path() -> pa.RecordBatch:
        ends = [so_far[s] for s in ACCEPTED if s in so_far]
        least = min(w[0] for w in ends)
        ends = [w for w in ends if w[0] == least]
        _, _, chain = min(ends, key=lambda w: audit_of(w[1])) if len(ends) > 1 else ends[0]
        states = []
        while chain:
            states.append(chain[0])
            chain = chain[1]
        states.reverse()
        return _arrow([{"conv_id": conv, "piece": p, "entry": a, "left": b} for p, a, b in zip(pieces, ["Start", *states], states, strict=False)], schema)

    for batch in batches:
        for row in batch.select(["conv_id", "piece", "paths"]).to_pylist():
            if begun and row["conv_id"] != conv:
                yield path()
                begun = False
            if not begun:
                begun, conv, pieces, so_far = True, row["conv_id"], [], {"Start": (0, (), ())}
            pieces.append(row["piece"])
            table, onward = _loaded(row["paths"]), {}
            for after in STATES:
                found = [(cost + table[before][after][0], chain, table[before][after][1], before, states) for before, (cost, chain, states) in so_far.items() if after in table[before]]
                if not found:
                    continue
                least = min(f[0] for f in found)
                found = [f for f in found if f[0] == least]
                best = found[0] if len(found) == 1 else min(found, key=lambda f: audit_of(f[1]) + f[2])
                onward[after] = (least, (best[2], best[1]), (after, best[4]))
            so_far = onward
    if begun:
        yield path()


def _repair_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(REPAIRED_SCHEMA)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            cost, audit = _loaded(row["paths"])[row["entry"]][row["left"]]
            messages = repaired(_loaded(row["packed"]), _loaded(row["tokens"]), audit, row["entry"])
            yield _arrow([{"conv_id": row["conv_id"], "piece": row["piece"], "whole": False, "messages": _messages(messages), "audit": audit, "cost": min(cost, LONGEST), **{c: row[c] for c in names}}], schema)


def repair_conversations(messages: DataFrame, piece_rows: int = PIECE, count: str | None = None) -> DataFrame:
    """``messages`` (conv_id, turn, role, text; ``count`` names a column of how often a row stands) to repaired pieces of conversations.

    One row a piece (most conversations are one): conv_id, piece (their order), whole, messages, audit, cost and counts.
    """
    with_small_batches(messages.sparkSession)
    n = (F.col(count) if count else F.lit(1)).cast("long")
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"), n.alias("n"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = ["conv_id", "turn", "role", "text"]
    # The name of a conversation that has lost all its rows must survive; other rows with n = 0 tell nothing.
    pieces = keep_plan_short(counted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _cut(batches, piece_rows), PIECE_SCHEMA))
    whole = pieces.where("whole").mapInArrow(_repair_whole, REPAIRED_SCHEMA)

    rest = pieces.where("not whole").drop("whole")
    first = rest.mapInArrow(_keys, "conv_id long, part long, key binary").groupBy("conv_id", "key").agg(F.min("part").alias("part")).groupBy("conv_id", "part").agg(F.collect_list("key").alias("keys"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    told = rest.join(first, same(rest, first) & (rest["part"] == first["part"]), "left").select(rest["conv_id"], rest["part"], "packed", "keys")
    parsed = keep_plan_short(told.mapInArrow(_parse_pieces, PARSED_SCHEMA))
    tables = parsed.select("conv_id", "piece", "paths").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    chosen = tables.mapInArrow(_choose, "conv_id long, piece long, entry string, left string").withColumnsRenamed({"conv_id": "of", "piece": "at"})
    on_path = parsed.join(chosen, parsed["conv_id"].eqNullSafe(chosen["of"]) & (parsed["piece"] == chosen["at"])).drop("of", "at")
    return whole.unionByName(on_path.mapInArrow(_repair_pieces, REPAIRED_SCHEMA))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, by conversation, to one row a conversation."""
    schema = _schema(REPORT_SCHEMA)
    conv, begun = None, False
    sums: dict[str, int] = {}
    audits: list[str] = []
    last, low, high, turns, any_message, digest = None, None, None, 0, False, hashlib.sha256()

    def row() -> dict:
        gaps = 0 if low is None else max(0, high - low + 1 - turns)
        return {"conv_id": conv, "gaps": min(gaps, LONGEST), **{k: min(v, LONGEST) for k, v in sums.items()}, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        for k in range(batch.num_rows):
            p = batch.slice(k, 1).to_pylist()[0]
            if begun and p["conv_id"] != conv:
                yield _arrow([row()], schema)
                begun = False
            if not begun:
                begun, conv, audits, last, low, high, turns, any_message, digest = True, p["conv_id"], [], None, None, None, 0, False, hashlib.sha256()
                sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for name in sums:
                sums[name] += p[name]
            if p["first"] is not None:
                sums["illegal"] += last is not None and last + p["first"] not in ("su", "ua", "au")
                last = p["last"]
            if p["least_turn"] is not None:
                turns += p["turns"] - (high == p["least_turn"])
                low, high = p["least_turn"] if low is None else low, p["most_turn"]
            audits.append(p["audit"])
            for m in p["messages"]:
                digest.update(("\n" * any_message + m["role"] + ":" + m["text"]).encode("utf-8", "surrogatepass"))
                any_message = True
    if begun:
        yield _arrow([row()], schema)


def repair_report(pieces: DataFrame) -> DataFrame:
    """Repaired pieces to one row a conversation: faults as found, cost and audit of the repair, digest of what it left."""
    split = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return pieces.where("whole").mapInArrow(_report, REPORT_SCHEMA).unionByName(split.mapInArrow(_report, REPORT_SCHEMA))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32("conv_id:turn") % 20: 0 drops (n = 0), 1 empties, 2 takes ``.!?``, 3 repeats (n = 2), 4 makes a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    dropped = lambda x: F.when(F.col("fault") != 0, x)
    marked = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    return marked.select(
        "conv_id",
        dropped(F.col("turn")).alias("turn"),
        dropped(F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))).alias("role"),
        dropped(F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("n"),
    )
