"""Cheapest repairs of conversations' turn structure, by scalar big-integer weights.

A conversation's role initials must read ``(s?(ua)+)?`` after editing: keep a
turn (0), rerole it to user or assistant (2), delete it (3; a must for blank
and repeated turns), insert an empty user or assistant turn (2); an
undeleted truncated turn adds 1.  The edits' initials are the audit; of the
cheapest the ASCII-least is taken.

An edit sequence weighs one whole number: the cost in the high digits, below
them a fixed number of base-8 digits, the audit's letters from the highest
digit on (D, I, K, R as 1 to 4) and zeros after its end.  The least number
is then the cheapest and among equals the ASCII-least sequence, a shorter
one before its extensions, so a plain minimum over the edges of the DAG
(turn, state of the pattern) decides everything.  The DP runs from the last
turn to the first: an edge adds its cost and moves the letters one digit down.

Turns are placed by a range partition on (conversation, turn), and a chunk is
what ``CHUNK`` turns of one task hold of a conversation.  Chunks are solved
apart, for every state they may end in, and a conversation's chunks are put
together from the last: a state's letters in a chunk of fixed turns fix the
way through it, so the least number of a chunk stays least in the whole.
Nothing of a conversation but a chunk, its numbers and its audit is held in a
task; its texts pass through as a stream.

Turns stand in the order of ``turn``, null first, then in the order of the
columns ``ties``; equal rows are turns of their own.  A role's initial is its
first character; others than s, u, a (also none) fit nowhere.  Rows without
a conversation id are left out; ids without rows have zeros and an empty
audit.  Texts may be empty or very long.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepcorpus.llm.crc import CRC_TABLE, crc32_sql
from stepcorpus.llm.ordered import EMPTY, hash_in_order
from stepcorpus.session import materialize

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS  # turns of a chunk at most
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # digits in the order of the letters
LETTERS = str.maketrans("1234", "DIKR")
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2, "truncated": 1}
#: States of the pattern: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the one role of user and assistant that fits
FINAL = (START, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}


def code_of(initial: int, fault: int) -> str:
    """A turn as a letter: initial 0 to 3 (s, u, a, another), fault 0 to 3 (none, truncated, blank, repeated)."""
    return chr(65 + 4 * initial + fault)


# ---------------------------------------------------------------- the DP

def _prefixed(weight: int, digit: int, cost: int, width: int) -> int:
    """The number of an edit followed by what ``weight`` stands for."""
    low = weight & ((1 << 3 * width) - 1)
    return weight - low + (cost << 3 * width) + (digit << 3 * (width - 1)) + (low >> 3)


def chunk_weights(codes: str, ends: Sequence[int | None], width: int) -> list[int | None]:
    """The least number from each state before the turns ``codes`` on, where ``ends`` has those after them."""
    least = lambda xs: min((x for x in xs if x is not None), default=None)
    put = lambda w, digit, cost: None if w is None else _prefixed(w, digit, cost, width)
    after = list(ends)
    for code in reversed(codes):
        initial, fault = divmod(ord(code) - 65, 4)
        base = []
        for state in range(4):
            options = [put(after[state], DELETE, COST[DELETE])]
            if fault < 2:
                late = COST["truncated"] * fault
                options.append(put(after[NEXT[state]], REROLE, COST[REROLE] + late))
                if initial == 0 and state == START:
                    options.append(put(after[SYSTEM], KEEP, late))
                elif initial in (1, 2) and NEXT[state] == (USER, ASSISTANT)[initial - 1]:
                    options.append(put(after[NEXT[state]], KEEP, late))
            base.append(least(options))
        user = least([base[USER], put(base[ASSISTANT], INSERT, COST[INSERT])])  # two inserts lead back, so one is enough
        after = [least([base[START], put(user, INSERT, COST[INSERT])]), least([base[SYSTEM], put(user, INSERT, COST[INSERT])]),
                 user, least([base[ASSISTANT], put(base[USER], INSERT, COST[INSERT])])]
    return after


def final_weights(width: int) -> list[int]:
    """The numbers after the last turn: what must be inserted to end the pattern."""
    one = _prefixed(0, INSERT, COST[INSERT], width)
    return [0, _prefixed(one, INSERT, COST[INSERT], width), one, 0]


def chunk_width(codes: str) -> int:
    return 3 * len(codes) + 3  # an edit and at most two inserts a turn, and the end's


def chunk_matrix(codes: str, last: bool) -> list[list[int | None]]:
    """Numbers by end state and start state; of a conversation's last chunk by start state alone."""
    width = chunk_width(codes)
    if last:
        return [chunk_weights(codes, final_weights(width), width)]
    return [chunk_weights(codes, [0 if s == end else None for s in range(4)], width) for end in range(4)]


def _followed(weight: int, width: int, rest: int, rest_width: int) -> int:
    """The number of ``weight``'s letters and then ``rest``'s."""
    low = weight & ((1 << 3 * width) - 1)
    gap = ((low & -low).bit_length() - 1) // 3 if low else width  # zeros after the letters
    rest_low = rest & ((1 << 3 * rest_width) - 1)
    cost = (weight >> 3 * width) + (rest >> 3 * rest_width)
    return (cost << 3 * (width + rest_width)) + (low << 3 * rest_width) + (rest_low << 3 * gap)


def whole_weight(matrices: Sequence[tuple[int, list[list[int | None]]]]) -> tuple[int, int]:
    """(number, width) of the best edits of a conversation's chunks (width, matrix)."""
    width, (after,) = matrices[-1]
    for w, by_end in reversed(matrices[:-1]):
        after = [min((_followed(by_end[end][start], w, after[end], width) for end in range(4) if by_end[end][start] is not None and after[end] is not None), default=None)
                 for start in range(4)]
        width += w
    return after[START], width


def decoded(weight: int, width: int) -> tuple[int, str]:
    """(cost, audit) of a number."""
    digits = format(weight & ((1 << 3 * width) - 1), "o").zfill(width).rstrip("0")
    return weight >> 3 * width, digits.translate(LETTERS)


def edits_of(codes: str, audit: str) -> list[str]:
    """What happens at each turn: inserted roles' initials (u, a), then K, D or the new role's initial as a
    capital (U, A); what is inserted at the end follows the last turn's."""
    state, out, before, turns = START, [], "", iter(codes)
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            before += ROLES[state][0]
            continue
        initial = (ord(next(turns)) - 65) // 4
        if letter == "K":
            state = SYSTEM if initial == 0 else NEXT[state]
        elif letter == "R":
            state = NEXT[state]
            letter = ROLES[state][0].upper()
        out.append(before + letter)
        before = ""
    if before:
        out[-1] += before
    return out


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows with their numbers (bytes; none where no way leads)."""
    for batch in batches:
        rows = []
        for codes, last in zip(batch.column("codes").to_pylist(), batch.column("last").to_pylist()):
            rows.append([b"" if w is None else w.to_bytes(w.bit_length() // 8 + 1, "big") for line in chunk_matrix(codes, last) for w in line])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.binary()))], [*batch.schema.names, "weights"])


def _illegal(codes: str) -> int:
    """Neighbours whose initials don't read su, ua or au."""
    initials = [(ord(c) - 65) // 4 for c in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by conversation and place: a row of edits for each, the first of a conversation with its totals."""
    names = ["conv_id", "first", "edits", "cost", "illegal", "audit"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]

    def conversation(rows: list[tuple]) -> list[tuple]:
        matrices = []
        for _, _, codes, weights in rows:
            numbers = [int.from_bytes(w, "big") if w else None for w in weights]
            matrices.append((chunk_width(codes), [numbers[i:i + 4] for i in range(0, len(numbers), 4)]))
        cost, audit = decoded(*whole_weight(matrices))
        codes = "".join(r[2] for r in rows)
        edits, out = edits_of(codes, audit), []
        for i, (conv_id, first, part, _) in enumerate(rows):
            out.append((conv_id, first, edits[:len(part)], *((None, None, None) if i else (cost, _illegal(codes), audit))))
            edits = edits[len(part):]
        return out

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "first", "codes", "weights"))):
            if held and row[0] != held[0][0]:
                out += conversation(held)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*conversation(held)), kinds)], names)


# ---------------------------------------------------------------- tables

def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the tie columns ``source`` and ``copy``: each row damaged by the checksum
    of ``conv_id:turn`` modulo 20.  A null role, text or (in the checksum) turn is one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), _digest(role, text).alias("source"),
        (F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20).alias("fault"))
    copies = F.when(F.col("fault") == 0, F.array().cast("array<int>")).when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
                       "source", F.explode(copies).alias("copy"))


def placed(rows: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """conv_id, turn, role, text, digest and ``at``: a number that grows along each conversation; written."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    out = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                                                           _digest(role, text).alias("digest"), *(F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)))
    order = ["conv_id", "turn", *(f"tie{i}" for i in range(len(ties))), "digest"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(out.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at")), "turns")


def coded(turns: DataFrame) -> DataFrame:
    """conv_id, turn, at and ``code`` of every placed turn; written."""
    firsts = turns.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    facts = turns.select("conv_id", "turn", "at", initial.alias("initial"), (shown == "").alias("blank"), F.right(shown, F.lit(1)).isin(*ENDS).alias("ended"))
    fault = F.when(F.col("blank"), 2).when(F.col("is_first").isNull(), 3).when(~F.col("ended"), 1).otherwise(0)
    return materialize(facts.join(firsts, "at", "left").select("conv_id", "turn", "at", F.char(65 + 4 * F.col("initial") + fault).alias("code")), "codes")


def solved(codes: DataFrame) -> DataFrame:
    """conv_id, first (``at`` of the chunk's first turn), edits, and of each conversation's first chunk cost, illegal, audit; written."""
    chunks = (codes.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "code"))).alias("turns"))
              .select("conv_id", "chunk", "first", F.array_join(F.transform("turns", lambda t: t["code"]), "").alias("codes")))  # CHUNK turns at most
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "first", "codes", F.count(F.lit(1)).over(later).alias("later")).select("conv_id", "first", "codes", (F.col("later") == 0).alias("last"))
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighed = chunks.repartition(n, "conv_id", "first").mapInArrow(_solved, "conv_id long, first long, codes string, last boolean, weights array<binary>")
    return materialize(weighed.repartition(n, "conv_id").sortWithinPartitions("conv_id", "first")
                       .mapInArrow(_together, "conv_id long, first long, edits array<string>, cost long, illegal long, audit string"), "edits")


def _turns_of(edit: str, role: str, text: str) -> Column:
    """The turns that one edit leaves, as structs of role and text."""
    made = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    user, assistant, none = F.lit("user"), F.lit("assistant"), F.lit("")
    letters = F.filter(F.split(edit, ""), lambda c: c.isin("u", "a", "K", "U", "A"))
    return F.transform(letters, lambda c: F.when(c == "u", made(user, none)).when(c == "a", made(assistant, none)).when(c == "U", made(user, F.col(text)))
                       .when(c == "A", made(assistant, F.col(text))).otherwise(made(F.col(role), F.col(text))))


def _repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    each = edits.select("first", F.posexplode("edits").alias("i", "edit")).select((F.col("first") + F.col("i")).alias("at"), "edit")
    return turns.select("conv_id", "at", "role", "text").join(each, "at").select("conv_id", "at", _turns_of("edit", "role", "text").alias("turns"))


def repair(conversations: DataFrame, ties: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(audits, repaired)``: conv_id, cost, audit, gaps, blank, duplicate, truncated, illegal of every
    conversation, and its repaired turns as conv_id, at, place, role, text, in the order of at and place."""
    turns = placed(conversations, ties)
    audits, rows = _repair(turns)
    return audits, rows.select("conv_id", "at", F.posexplode("turns").alias("place", "t")).select("conv_id", "at", "place", "t.role", "t.text")


def _repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    codes = coded(turns)
    edits = solved(codes)
    fault = (F.ascii("code") - 65) % 4
    faults = codes.groupBy("conv_id").agg(*(F.count_if(fault == n).alias(name) for name, n in (("blank", 2), ("duplicate", 3), ("truncated", 1))))
    wide = lambda f: f("turn").cast("decimal(38,0)")
    gap = wide(F.max) - wide(F.min) + 1 - F.count("turn")
    gaps = codes.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.least(F.coalesce(gap, F.lit(0).cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long").alias("gaps"))
    totals = edits.filter("audit is not null").select("conv_id", "cost", "illegal", "audit")
    return totals.join(faults, "conv_id").join(gaps, "conv_id"), _repaired(turns, edits)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after ``damaged``."""
    turns = placed(damaged(conversations), ("source", "copy"))
    audits, rows = _repair(turns)
    lines = rows.filter(F.size("turns") > 0).select("conv_id", "at", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary").alias("piece"))
    hashes = hash_in_order(lines, ["conv_id"], "at", "repaired_sha256", "\n")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).filter("conv_id is not null").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (ids.join(audits, "conv_id", "left").join(hashes, "conv_id", "left")
            .select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")))


def brute_force(rows: list[tuple], harm: bool = True) -> list[tuple]:
    """The literal result of (conv_id, turn, role, text) rows, by (cost, audit) pairs; without ``harm`` as they stand."""
    from functools import cache
    from hashlib import md5, sha256
    from zlib import crc32
    by: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        held = by.setdefault(c, [])
        role, text = (x if x is not None else " " if harm else "" for x in (role, text))
        tie = md5(f"{len(role)}:{role}{text}".encode()).digest()
        kind = crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20 if harm else 5
        if kind:
            text = "" if kind == 1 else "".join(x for x in text if x not in ENDS) if kind == 2 else text
            held += [((turn is not None, turn or 0), tie, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, held in by.items():
        turns = [t[2:] for t in sorted(held, key=lambda t: t[:2])]
        shown = [t.rstrip(SPACES) for _, _, t in turns]
        blank = [not s for s in shown]
        again = [not b and (r, t) in {x[1:] for x in turns[:i]} for i, ((_, r, t), b) in enumerate(zip(turns, blank))]
        late = [not b and not d and s[-1] not in ENDS for b, d, s in zip(blank, again, shown)]
        initials = [r[:1] for _, r, _ in turns]
        numbers = [n for n, _, _ in turns if n is not None]

        @cache
        def best(i: int, state: str, inserts: int) -> tuple:
            """The least (cost, audit, lines) from turn i on; ``state`` is the last initial."""
            want = "a" if state == "u" else "u"
            options = []
            if i == len(turns):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, role, text = turns[i]
                x = best(i + 1, state, 0)
                options.append((x[0] + 3, "D" + x[1], x[2]))
                if not blank[i] and not again[i]:
                    x = best(i + 1, want, 0)
                    options.append((x[0] + 2 + late[i], "R" + x[1], (f"{ROLES[USER] if want == 'u' else ROLES[ASSISTANT]}:{text}", *x[2])))
                    if initials[i] == want or initials[i] == "s" and state == "":
                        x = best(i + 1, initials[i], 0)
                        options.append((x[0] + late[i], "K" + x[1], (f"{role}:{text}", *x[2])))
            if inserts < 3:
                x = best(i, want, inserts + 1)
                options.append((x[0] + 2, "I" + x[1], (f"{ROLES[USER] if want == 'u' else ROLES[ASSISTANT]}:", *x[2])))
            return min(options, default=(10 ** 9, "", ()))

        cost, audit, lines = best(0, "", 0)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, sum(blank), sum(again), sum(late), illegal, cost, audit,
                    sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def _edit_sql(state: str, cost: str, letter: str, line: str) -> str:
    return f"case when {state} is not null then [lpad((left({state}[1], 9)::int + {cost})::varchar, 9, '0') || '{letter}' || substr({state}[1], 10), {line} || {state}[2]] end"


def _base_sql(state: int) -> str:
    after = f"v{NEXT[state]}"
    role, initial = ROLES[NEXT[state]], "ua"[NEXT[state] == ASSISTANT]
    options = [_edit_sql(f"v{state}", "3", "D", "''"), f"case when f.fault < 2 then {_edit_sql(after, '2 + f.fault', 'R', f"'{role}:' || f.text || chr(10)")} end",
               f"case when f.fault < 2 and f.initial = '{initial}' then {_edit_sql(after, 'f.fault', 'K', "f.role || ':' || f.text || chr(10)")} end"]
    if state == START:
        options.append(f"case when f.fault < 2 and f.initial = 's' then {_edit_sql('v1', 'f.fault', 'K', "f.role || ':' || f.text || chr(10)")} end")
    return f"least({', '.join(options)}) as b{state}"


_U, _A = (f"'{r}:' || chr(10)" for r in ("user", "assistant"))
_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
with recursive {CRC_TABLE},
z as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("(conv_id || ':' || coalesce(turn::varchar, ' '))")} % 20 as kind from conversations, crc where conv_id is not null),
d as (select conv_id, turn, md5(length(role) || ':' || role || text) as source, case kind when 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then translate(text, '{ENDS}', '') else text end as text, unnest(case kind when 0 then [] when 3 then [0, 1] else [0] end) as copy from z),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, source, copy) as i, left(role, 1) as initial, rtrim(text, {_SPACES_SQL}) as shown from d),
f as (select *, case when shown = '' then 2 when row_number() over (partition by conv_id, role, text order by i) > 1 then 3 when right(shown, 1) not in ('.', '!', '?') then 1 else 0 end as fault,
  lag(initial) over (partition by conv_id order by i) || initial as pair from r),
n as (select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate,
  count(*) filter (fault = 1) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
w as (select conv_id, n + 1 as i, ['000000000', ''] as v0, ['000000004II', {_U} || {_A}] as v1, ['000000002I', {_A}] as v2, ['000000000', ''] as v3 from n
  union all select conv_id, i, least(b0, {_edit_sql('u', '2', 'I', _U)}), least(b1, {_edit_sql('u', '2', 'I', _U)}), u, least(b3, {_edit_sql('b2', '2', 'I', _U)}) from
  (select *, least(b2, {_edit_sql('b3', '2', 'I', _A)}) as u from (select w.conv_id, f.i, {', '.join(map(_base_sql, range(4)))} from w join f on f.conv_id = w.conv_id and f.i = w.i - 1))),
best as (select conv_id, left(v0[1], 9)::bigint as cost, substr(v0[1], 10) as audit, v0[2] as lines from w where i = 1)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(left(coalesce(lines, ''), greatest(length(coalesce(lines, '')) - 1, 0))) as repaired_sha256
from (select distinct conv_id from z) left join n using (conv_id) left join best using (conv_id)
"""
