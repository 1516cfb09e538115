"""Conversation structure repair: a fold over sorted turns with native higher-order functions.

Every row of a conversation is kept, given another role, or deleted, and empty turns are inserted, so that
the initials of the roles read (s?(ua)+)? at the least cost. The fold carries four (cost, audit) structs, the
best for each state: nothing yet (e), after a system turn (s), after a user turn (u), after an assistant's (a).
least() picks the cheaper and, of equal ones, the audit that is least in ASCII. That is safe prefix by prefix:
of two audits of one cost over the same rows none begins the other, since what an audit costs can be read off it.

A conversation may hold any share of all rows, so no step but the last needs it in one place: rows are
numbered by range partitions, repeats found by grouped minima, and blocks of BLOCK turns folded by
themselves, each from all four states; a second fold of the same form goes over the blocks. The repaired
text of a conversation is one value, and so must fit one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.mixing import numbered
from barloom.llm.scratch import stage

BLOCK = 512
#: What edits cost, and what a truncated turn adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = ("e", "s", "u", "a")
_SPACES = " \t\n\x0b\f\r"
_NEVER = 1 << 50


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows dropped, emptied, stripped of stops, repeated or given the role
    user by crc32(conv_id:turn) % 20 = 0 to 4; the rest as they are. Null roles and texts become one space, and
    so do nulls in the key."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _cost(p: str, add: str, letter: str) -> str:
    return f"named_struct('cost', {p}.cost + {add}, 'audit', concat({p}.audit, {letter}))"


def _states(e: str, s: str, u: str, a: str) -> str:
    return f"named_struct('e', {e}, 's', {s}, 'u', {u}, 'a', {a})"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _inserted(x: str) -> str:
    """The states after any insertions: a user's turn after anything but one, then an assistant's."""
    put = lambda p: _cost(p, f"{INSERT}L", "'I'")
    user = f"least({x}.u, {put(f'{x}.e')}, {put(f'{x}.s')}, {put(f'{x}.a')})"
    return _let(user, "v", _states(f"{x}.e", f"{x}.s", "v", f"least({x}.a, {put('v')})"))


def _row(y: str, t: str) -> str:
    """The states after a row (initial, must: it has to go, cut: it is truncated)."""
    gone = {k: _cost(f"{y}.{k}", f"{DELETE}L", "'D'") for k in STATES}
    extra = f"if({t}.cut, {TRUNCATED}L, 0L)"

    def to(p: str, role: str) -> str:
        return _cost(p, f"if({t}.initial = '{role}', {KEEP}L, {REROLE}L) + {extra}", f"if({t}.initial = '{role}', 'K', 'R')")

    user = _let(f"least({y}.e, {y}.s, {y}.a)", "p", to("p", "u"))
    kept = _states(gone["e"], f"if({t}.initial = 's', least({gone['s']}, {_cost(f'{y}.e', extra, chr(39) + 'K' + chr(39))}), {gone['s']})", f"least({gone['u']}, {user})", f"least({gone['a']}, {to(f'{y}.u', 'a')})")
    return f"if({t}.must, {_states(*gone.values())}, {kept})"


def _from(state: str) -> str:
    """The four states when a fold begins in one of them."""
    return _states(*[f"named_struct('cost', {0 if k == state else _NEVER}L, 'audit', '')" for k in STATES])


def _fold(turns: str, state: str) -> str:
    return f"aggregate({turns}, {_from(state)}, (x, t) -> {_let(_inserted('x'), 'y', _row('y', 't'))})"


def _joined() -> str:
    """The states after a block whose folds from each state are known."""
    after = lambda k: "least(" + ", ".join(f"named_struct('cost', x.{j}.cost + b.{j}.{k}.cost, 'audit', concat(x.{j}.audit, b.{j}.{k}.audit))" for j in STATES) + ")"
    return _states(*[after(k) for k in STATES])


def faults(rows: DataFrame) -> DataFrame:
    """Staged rows of damage() with pos (1, 2, ... within the conversation, by turn, nulls first; within a turn by
    role and the MD5 of the text, copies side by side), initial, and fault: blank, duplicate, truncated or null."""
    keyed = rows.withColumn("dated", F.col("turn").isNotNull()).withColumn("mark", F.md5("text"))
    placed = stage(numbered(keyed, "conv_id", "dated", "turn", "role", "mark", "copy"), "turns")
    first = placed.groupBy("conv_id").agg(F.min("rank").alias("first"))
    seen = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("same")).agg(F.min("rank").alias("seen"))
    same = placed.withColumn("same", F.sha2("text", 256)).alias("t")
    joined = same.join(first.alias("f"), F.expr("t.conv_id <=> f.conv_id")).join(seen.alias("k"), F.expr("t.conv_id <=> k.conv_id and t.role = k.role and t.same = k.same"))
    ends = F.right(F.rtrim("t.text", F.lit(_SPACES)), F.lit(1))
    fault = F.when(ends == "", "blank").when(F.expr("k.seen < t.rank"), "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    return stage(joined.select("t.conv_id", "t.turn", "t.role", "t.text", (F.expr("t.rank - f.first") + 1).alias("pos"), F.left("t.role", F.lit(1)).alias("initial"), fault.alias("fault")), "faults")


def _audits(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit, illegal of each conversation that has rows."""
    turn = F.struct("pos", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    blocks = rows.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    folds = ", ".join(f"'{k}', " + (_fold("turns", k) if k == "e" else f"if(block = 0, {_from(k)}, {_fold('turns', k)})") for k in STATES)
    legal = "('su', 'ua', 'au')"
    pairs = f"size(filter(zip_with(slice(turns, 1, size(turns) - 1), slice(turns, 2, size(turns)), (x, y) -> concat(x.initial, y.initial)), p -> p not in {legal}))"
    # one struct a block, and a block has BLOCK rows: a conversation's list of them is short
    each = blocks.select("conv_id", F.expr(f"struct(block, named_struct({folds}) as ways, {pairs} as illegal, turns[0].initial as head, turns[size(turns) - 1].initial as tail) as b"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    final = f"aggregate(transform(bs, b -> b.ways), {_from('e')}, (x, b) -> {_joined()}, x -> {_let(_inserted('x'), 'y', 'least(y.e, y.a)')})"
    seams = f"size(filter(zip_with(slice(bs, 1, size(bs) - 1), slice(bs, 2, size(bs)), (x, y) -> concat(x.tail, y.head)), p -> p not in {legal}))"
    return whole.select("conv_id", F.expr(final).alias("best"), F.expr(f"aggregate(bs, 0L, (n, b) -> n + b.illegal) + {seams}").alias("illegal")).select("conv_id", "best.cost", "best.audit", "illegal")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, edit of every turn of the repaired conversations, seq ascending from 1 with holes.

    The audit tells all: after a kept system turn, users and assistants take turns.
    """
    edits = audits.select("conv_id", "audit", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(0, length(audit) - 1) div {BLOCK}"))).alias("part"))
    piece = F.expr(f"substr(audit, part * {BLOCK} + 1, {BLOCK})")
    before = F.expr(f"substr(audit, 1, part * {BLOCK})")
    without = lambda c, ch: F.length(F.translate(c, ch, ""))
    # rows and turns before the part, then within it
    edits = edits.select("conv_id", piece.alias("piece"), F.col("part"), without(before, "I").alias("rows"), without(before, "D").alias("kept"))
    edits = edits.select("conv_id", "rows", "kept", "part", "piece", F.posexplode(F.split("piece", "")).alias("at", "edit")).where("edit <> ''")
    upto = F.expr("substr(piece, 1, at + 1)")
    edits = edits.select("conv_id", (F.col("part") * BLOCK + F.col("at") + 1).cast("long").alias("seq"), "edit", F.when(F.col("edit") != "I", F.col("rows") + without(upto, "I")).cast("long").alias("pos"), (F.col("kept") + without(upto, "D")).alias("n")).where("edit <> 'D'")
    lead = rows.join(edits.where("n = 1 and edit = 'K'").select(F.col("conv_id").alias("c"), F.col("pos").alias("p")), F.expr("conv_id <=> c and pos = p")).where("initial = 's'").select(F.col("conv_id").alias("c"))
    edits = edits.join(lead.withColumn("system", F.lit(1)), F.expr("conv_id <=> c"), "left").drop("c")
    turn = F.when((F.col("n") - F.coalesce("system", F.lit(0))) % 2 == 1, "user").otherwise("assistant")
    edits = edits.withColumn("given", turn).alias("e")
    texts = rows.select("conv_id", "pos", "role", "text").alias("t")
    return edits.join(texts, F.expr("e.conv_id <=> t.conv_id and e.pos = t.pos"), "left").select("e.conv_id", "e.seq", F.when(F.col("e.edit") == "K", F.col("t.role")).otherwise(F.col("e.given")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"), "e.edit")


def _texts(turns: DataFrame) -> DataFrame:
    """conv_id, repaired: role:text of all turns, joined by newlines, block by block."""
    line = F.struct("seq", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    blocks = turns.withColumn("block", F.expr(f"seq div {BLOCK}")).groupBy("conv_id", "block").agg(ordered(line).alias("line"))
    return blocks.groupBy("conv_id").agg(ordered(F.struct(F.col("block").alias("seq"), "line")).alias("repaired"))


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    turns: conv_id, turn, role, text, in any order; they are damaged first (damage()), and all counts are of what
    that leaves. Null conv_ids are one conversation. A conversation of which nothing is left has zeros, an
    empty audit and an empty text. Only a role's first character decides whether it may be kept (s, u, a); a
    role without one is illegal. Further columns are ignored. An empty table gives no rows.
    """
    rows = faults(damage(turns))
    audits = stage(_audits(rows), "audits")
    of = lambda kind: F.sum((F.col("fault") == kind).cast("long")).alias(kind)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce((F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.countDistinct("turn")).try_cast("long"), F.when(F.count("turn") > 0, F.lit((1 << 63) - 1)), F.lit(0))
    counts = rows.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), *[F.coalesce(of(k), F.lit(0)).alias(k) for k in ("blank", "duplicate", "truncated")])
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    for part, name in ((counts, "c"), (audits, "a"), (_texts(repaired(rows, audits)), "r")):
        out = out.join(part.alias(name), F.expr(f"o.conv_id <=> {name}.conv_id"), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("o.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired"))


def digest(rows: DataFrame) -> DataFrame:
    """repair() with the SHA-256 of the repaired text in its place."""
    return rows.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
