"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is written ``<s>role[INST]text[/INST]``, or ``<s>role[INST]text</s>`` where its text is a training target.  In roles and texts
a backslash is doubled, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b``, so no control string can occur in them.

Turns stay rows: a conversation is numbered in slices, cut into chunks of bounded length, and only the token counts of a chunk
ever meet in one array.  Texts are gathered by window, so no row holds more than the budget allows or than one turn has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import stash

TURN, TEXT, CLOSED, TARGET = "<s>", "[INST]", "[/INST]", "</s>"
#: Letters and digits in a row are a token, any other visible character is one; a turn's marks count as three.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Turns of a chunk: windows and their history never cross from one chunk to the next.
CHUNK = 4096


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(parts, "\\")


def _numbered(turns: DataFrame) -> DataFrame:
    """Rows with their conversation's key, chunk and place in the chunk.

    A conversation may hold any share of the rows: it is numbered inside slices of CHUNK turn numbers, which are shifted by the sizes of the
    slices before them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"),  # a null id has a key that no number has
        F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("_slice"),
        "conv_id",
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(TOKEN)) + 3).alias("tokens"),
    )
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_c", "_slice").orderBy("turn", "role", "text")) - 1)
    earlier = Window.partitionBy("_c").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_c", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    place = F.col("_at") + F.col("_shift")
    out = inside.join(shift, ["_c", "_slice"])
    return out.select("_c", F.expr(f"(_at + _shift) div {CHUNK}").alias("chunk"), F.pmod(place, F.lit(CHUNK)).cast("int").alias("pos"), "conv_id", "role", "text", "tokens")


def format_windows(turns: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128) -> DataFrame:
    """Windows of whole turns: conv_id, window, n_context, n_tokens, formatted, loss_spans (start and length in characters).

    Prefix sums of turn tokens cut a conversation into spans: a span ends before the turn with which it, the system
    turn and the largest history would pass ``budget`` (a turn that is too long alone is a span alone, whole), and after every CHUNK turns.
    Each window is the first system turn, then up to ``history_turns`` turns before the span, of the same chunk, with at most
    ``history_tokens`` tokens, then the span; ``window`` is the place of the span's first turn in its conversation.  Only assistant
    turns of the span itself are targets; what is repeated is masked.  Null roles and texts are empty; rows of a
    conversation are ordered by turn (nulls first), then role, then text; repeated rows are repeated turns; a null conv_id is a conversation;
    an empty table gives no windows; other columns are not read.
    """
    rows = stash(_numbered(turns), "turns")  # read three times, with different columns
    system = rows.where("role = 'system'").groupBy("_c").agg(F.min_by(F.struct("chunk", "pos", "role", "text", "tokens"), F.struct("chunk", "pos")).alias("head"))
    # the only gathering by chunk is of two numbers a turn
    counts = rows.groupBy("_c", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("_t"))
    chunks = counts.join(system, "_c", "left").withColumn("_room", F.lit(budget - history_tokens) - F.coalesce(F.col("head.tokens"), F.lit(0)))
    fold = """aggregate(_t, named_struct('cuts', array(0), 'used', 0L), (acc, x) -> if(acc.used > 0 and acc.used + x.tokens > _room,
        named_struct('cuts', concat(acc.cuts, array(x.pos)), 'used', cast(x.tokens as bigint)),
        named_struct('cuts', acc.cuts, 'used', acc.used + x.tokens)), acc -> acc.cuts)"""
    chunks = chunks.select("_c", "chunk", "head", F.expr(fold).alias("_cuts"))

    keys = ["_c", "chunk"]
    placed = rows.join(chunks.select(*keys, "_cuts"), keys).withColumn("_begins", F.array_contains("_cuts", F.col("pos"))).drop("_cuts")
    order = Window.partitionBy(*keys).orderBy("pos")
    placed = placed.withColumn("_lo", F.max(F.when(F.col("_begins"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # a turn also stands, masked, in windows that begin within the next turns, as far as the tokens between allow
    windows = [F.struct(F.col("_lo").alias("lo"), F.lit(True).alias("own"))]
    gap = F.col("tokens")
    for k in range(1, history_turns + 1):
        near = F.lead("_begins", k).over(order) & (gap <= history_tokens)
        windows.append(F.when(near, F.struct((F.col("pos") + k).alias("lo"), F.lit(False).alias("own"))))
        gap = gap + F.lead("tokens", k).over(order)
    placed = placed.withColumn("_w", F.array_compact(F.array(*windows)))
    target = (F.col("role") == "assistant") & F.col("w.own")
    begin = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    member = placed.withColumn("w", F.explode("_w")).select(
        *keys,
        "conv_id",
        F.col("w.lo").alias("lo"),
        F.struct(
            "pos",
            F.col("w.own").alias("own"),
            F.concat(begin, body, F.when(target, TARGET).otherwise(CLOSED)).alias("piece"),
            F.length(begin).alias("before"),
            F.length(body).alias("length"),
            target.alias("target"),
            "tokens",
        ).alias("p"),
    )
    wins = member.groupBy(*keys, "lo").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list("p")).alias("p"))
    wins = wins.join(chunks.select(*keys, "head"), keys)
    # the system turn leads unless it is one of the turns that stand here anyway
    early = F.struct(F.col("head.chunk"), F.col("head.pos")) < F.struct(F.col("chunk"), F.col("p")[0]["pos"])
    wins = wins.withColumn("_led", F.coalesce(F.col("head").isNotNull() & early, F.lit(False)))
    lead = F.when(F.col("_led"), F.concat(F.lit(TURN), escape(F.col("head.role")), F.lit(TEXT), escape(F.col("head.text")), F.lit(CLOSED))).otherwise("")
    wins = wins.withColumn("_lead", lead)
    spans = F.expr("""aggregate(p, named_struct('at', length(_lead), 'out', cast(array() as array<struct<start:int,length:int>>)), (acc, x) -> named_struct(
        'at', acc.at + length(x.piece), 'out', if(x.target, concat(acc.out, array(named_struct('start', acc.at + x.before, 'length', x.length))), acc.out)), acc -> acc.out)""")
    context = F.size(F.filter("p", lambda x: ~x["own"])) + F.col("_led").cast("int")
    tokens = F.expr("aggregate(p, if(_led, head.tokens, 0), (acc, x) -> acc + x.tokens)")
    place = F.col("chunk") * CHUNK + F.col("lo")
    formatted = F.concat("_lead", F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return wins.select("conv_id", place.alias("window"), context.alias("n_context"), tokens.alias("n_tokens"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Parse windows back: conv_id, window, turns (role and text of the turns that are no repetition), loss_text, formatted_chars."""
    piece = F.expr(f"slice(split(formatted, '{TURN}'), n_context + 2, size(split(formatted, '{TURN}')))")
    turn = F.transform(
        piece,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring(p, F.instr(p, TEXT) + len(TEXT), F.length(p)), r"(\[/INST\]|</s>)\z", "")).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", turn.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def op7_chat(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows.  A digest is of one whole text, so this query alone gathers a conversation in a row."""
    spark = conversations.sparkSession
    same = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L conv_id, pos turn, role, '{same}' text FROM (SELECT posexplode(array('user', 'assistant')) AS (pos, role))")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    rows = rows.union(extra.select("conv_id", F.col("turn").cast("long"), "role", "text"))
    back = read_windows(stash(format_windows(rows), "chat"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = back.select("conv_id", F.struct("window", F.size("turns").alias("n"), listed.alias("listed"), "loss_text", "formatted_chars").alias("w"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.formatted_chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda w: w["loss_text"]), "")
    turns = F.array_join(F.transform("w", lambda w: w["listed"]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
