"""Words and segments meet speaker turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtables.functions.text import strip, word_array
from speechtables.functions.times import word_anchor
from speechtables.operators.utterances import join_text
from speechtables.plans.asof import next_mark
from speechtables.plans.intervals import time_block
from speechtables.plans.ordered import BLOCK_ROWS, neighbours, row_block, run_ids, scan, with_ordinal
from speechtables.session import cut_lineage

KEYS = ("recording_id",)
SENTENCE_END = "[.?!]$"


def words_to_turns(
    words: DataFrame, turns: DataFrame, width: int, anchor: str = "start", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Adds ``speaker``: that of the first turn ending at or after the word's anchor, the last turn
    beyond the end. Turns are ordered and do not overlap (see ``resolve_overlaps``)."""
    marks = turns.select(*keys, "seq", "end", "speaker")
    points = words.withColumn("__anchor", word_anchor(F.col("start"), F.col("end"), anchor))
    found = next_mark(points, "__anchor", marks, "end", keys, ["seq"], width)
    return found.withColumn("speaker", F.col("mark.speaker")).drop("mark", "__anchor")


def segments_to_turns(
    segments: DataFrame,
    words: DataFrame,
    turns: DataFrame,
    threshold: float,
    width: int,
    keys: Sequence[str] = KEYS,
    compat: bool = False,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Segments labelled with the turn they lie in, cut where a turn ends inside them.

    A turn whose end is less than ``threshold`` after a point is over at that point. Words (and the
    segment's own start) look up their turn; a piece ends before the first word of a later turn,
    unless the segment's end lies within ``threshold`` of the current turn's end. The last turn has
    no end. After a cut the longer of two neighbouring pieces decides the speaker of the shorter.

    When even the first word lies past the turn, that word stands alone; ``compat`` repeats it in
    the following piece as well.

    Segments have ``seq, start, end, text``, words ``seq, pos, word, start, end``, turns ``seq, end,
    speaker``; segments and turns are ordered, neither overlaps by more than ``threshold``.
    """
    edges = neighbours(turns.select(*keys, "seq", "end", "speaker"), keys, "seq", prev={"__p": F.col("seq")}, next={"__n": F.col("seq")}, rows=rows)
    marks = edges.select(
        *keys, "seq", "end", "speaker", F.col("__n").isNull().alias("last"), F.col("__p").isNull().alias("first")
    )
    heads = segments.select(*keys, "seq", F.lit(-1).alias("pos"), "start", F.col("end").alias("segment_end"))
    points = heads.unionByName(words.select(*keys, "seq", "pos", "start", "end"), allowMissingColumns=True)
    looked = next_mark(
        points.withColumn("__at", F.col("start") + threshold), "__at", marks, "end", keys, ["seq"], width
    )
    only = F.col("mark.first") & F.col("mark.last")
    past = F.col("mark.end") < F.col("__at")
    endless = F.col("mark.last") & (~only | past)
    inside = Window.partitionBy(*keys, "seq").orderBy("pos")
    placed = looked.select(
        *keys,
        "seq",
        "pos",
        "start",
        "end",
        (F.col("mark.seq") + (only & past).cast("bigint")).alias("turn"),
        F.when(~endless, F.col("mark.end")).alias("turn_end"),
        endless.alias("endless"),
        F.col("mark.speaker").alias("speaker"),
        F.first("segment_end").over(inside).alias("segment_end"),
    )
    late = (F.col("turn") > F.lag("turn").over(inside)) & (
        F.col("segment_end") > F.lag("turn_end").over(inside) + threshold
    )
    placed = placed.withColumn("__cut", (F.coalesce(late, F.lit(False)) & (F.col("pos") >= 0)).cast("int"))
    if compat:
        # the first word once more, as a piece of its own in front
        twice = F.when((F.col("pos") == 0) & (F.col("__cut") == 1), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        placed = placed.withColumn("__extra", F.explode(twice))
    else:
        shifted = F.coalesce(F.lag("__cut").over(inside), F.lit(0))
        cut0 = F.when(F.col("pos") == 0, 0).when(F.col("pos") == 1, F.greatest(F.col("__cut"), shifted)).otherwise(F.col("__cut"))
        placed = placed.withColumn("__cut", cut0).withColumn("__extra", F.lit(False))
    numbered = placed.withColumn(
        "piece", F.when(F.col("__extra"), 0).otherwise(F.sum(F.when(F.col("__extra"), 0).otherwise(F.col("__cut"))).over(inside))
    )
    pieces = numbered.groupBy(*keys, "seq", "piece").agg(
        F.min_by(F.struct("turn", "endless", "speaker"), "pos").alias("turn"),
        F.min(F.when(F.col("pos") >= 0, F.col("pos"))).alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.min_by("start", F.when(F.col("pos") >= 0, F.col("pos"))).alias("first_start"),
        F.max_by("end", "pos").alias("last_end"),
    )
    # a head without words in its piece (only possible in front of a cut first word) holds no text
    pieces = pieces.join(segments.select(*keys, "seq", "start", "end", "text"), [*keys, "seq"])
    count = F.max("piece").over(Window.partitionBy(*keys, "seq"))
    whole, final = count == 0, F.col("piece") == count
    tokens = word_array(F.col("text"))
    part = F.slice(tokens, F.col("first_pos") + 1, F.when(final, F.size(tokens)).otherwise(F.col("last_pos") - F.col("first_pos") + 1))
    pieces = cut_lineage(
        pieces.select(
            *keys,
            "seq",
            F.col("piece").cast("int").alias("piece"),
            F.when(whole, F.col("start")).otherwise(F.col("first_start")).alias("start"),
            F.when(final, F.col("end")).otherwise(F.col("last_end")).alias("end"),
            F.when(whole, F.col("text")).otherwise(F.array_join(part, " ")).alias("text"),
            F.col("turn.turn").alias("turn"),
            F.col("turn.endless").alias("endless"),
            F.col("turn.speaker").alias("turn_speaker"),
            (~final).alias("cut_after"),
            "first_pos",
            "last_pos",
        )
    )
    return _longer_piece_decides(pieces, keys, rows)


def _longer_piece_decides(pieces: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Adds ``speaker`` to pieces in order.

    The speaker in force is the turn's, taken over whenever the turn advances, except after a cut
    whose front piece is longer: then the speaker in force stays. A front piece that is shorter takes
    the speaker in force at the following piece. No exchange happens before the third row.
    """
    slim = pieces.select(
        *keys, "seq", "piece", "turn", "endless", "turn_speaker", "cut_after", F.length("text").alias("size")
    )
    order, block = ["seq", "piece"], row_block("seq", rows)
    row = F.struct("turn", "endless", "turn_speaker", "cut_after", "size")
    seen = scan(slim, keys, order, block, prev={"__p": row}, next={"__n": row}, total={"__at": F.lit(1)})

    def advances(earlier_turn, turn, endless):
        return earlier_turn.isNull() | (earlier_turn != turn) | endless

    stays = F.coalesce(F.col("__p.cut_after") & (F.col("__at") > 2) & (F.col("__p.size") > F.col("size")), F.lit(False))
    takes = advances(F.col("__p.turn"), F.col("turn"), F.col("endless")) & ~stays
    force = scan(
        seen.withColumn("__takes", takes), keys, order, block, latest={"force": F.when(F.col("__takes"), F.col("turn_speaker"))}
    )
    exchange = F.col("cut_after") & (F.col("__at") > 1)
    next_stays = exchange & (F.col("size") > F.col("__n.size"))
    next_force = F.when(
        advances(F.col("turn"), F.col("__n.turn"), F.col("__n.endless")) & ~next_stays, F.col("__n.turn_speaker")
    ).otherwise(F.col("force"))
    speaker = F.when(exchange & (F.col("size") < F.col("__n.size")), next_force).otherwise(F.col("force"))
    labels = force.select(*keys, "seq", "piece", speaker.alias("speaker"))
    return pieces.drop("turn", "endless", "turn_speaker", "cut_after").join(labels, [*keys, "seq", "piece"])


def channel_runs(words: DataFrame, width: int, keys: Sequence[str] = KEYS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Words of all channels in time order: ``at``, their place, and ``run``, neighbours of one channel."""
    ordered = with_ordinal(words, keys, ["start", "channel", "seq", "pos"], time_block("start", width), name="at")
    near = neighbours(ordered, keys, "at", prev={"__pc": F.col("channel")}, rows=rows)
    opens = F.col("__pc").isNull() | (F.col("__pc") != F.col("channel"))
    return run_ids(near, keys, "at", opens, rows=rows).drop("__pc")


def merge_channels(words: DataFrame, width: int, keys: Sequence[str] = KEYS, rows: int = BLOCK_ROWS) -> DataFrame:
    """Words of all channels in time order; neighbours of one channel form an utterance whose
    speaker is the channel. Words bring their own blanks, the text is stripped."""
    runs = channel_runs(words, width, keys, rows)
    pieces = runs.groupBy(*keys, "run", row_block("at", rows).alias("__block")).agg(
        F.min("at").alias("at"),
        F.min("channel").alias("speaker"),
        F.min_by("start", "at").alias("start"),
        F.max_by("end", "at").alias("end"),
        join_text("word", ["at"], "").alias("text"),
        F.count(F.lit(1)).alias("n_words"),
    )
    return pieces.groupBy(*keys, "run").agg(
        F.min("speaker").alias("speaker"),
        F.min_by("start", "at").alias("start"),
        F.max_by("end", "at").alias("end"),
        strip(join_text("text", ["at"], "")).alias("text"),
        F.sum("n_words").alias("n_words"),
    )


def realign_by_sentence(
    words: DataFrame, max_words: int = 50, keys: Sequence[str] = KEYS, at: str = "at", rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sentences of up to ``max_words`` words with several speakers go to their majority speaker.

    A sentence ends with a word that closes one. A majority needs at least half of the words (rounded
    down); ties go to the lower speaker. A last sentence without an end is looked at only when it has
    exactly ``max_words`` words. Only counts per sentence and speaker are gathered, never its words.
    """
    closes = F.col("word").rlike(SENTENCE_END)
    plain = words.select(*keys, at, "word", "speaker")
    numbered = cut_lineage(
        scan(plain, keys, [at], row_block(at, rows), total={"sentence": closes.cast("bigint")}).withColumn(
            "sentence", F.col("sentence") - closes.cast("bigint")
        )
    )
    by = [*keys, "sentence"]
    votes = numbered.groupBy(*by, "speaker").agg(F.count(F.lit(1)).alias("votes"), F.max(closes).alias("closed"))
    leader = F.max(F.struct("votes", (-F.col("speaker")).alias("lower")))
    counted = votes.groupBy(*by).agg(
        F.sum("votes").alias("n"), F.count(F.lit(1)).alias("voices"), F.max("closed").alias("closed"), leader.alias("top")
    )
    whole = (F.col("closed") & (F.col("n") <= max_words)) | (F.col("n") == max_words)
    decided = counted.filter(whole & (F.col("voices") > 1) & (F.col("top.votes") >= F.floor(F.col("n") / 2)))
    change = decided.select(*by, (-F.col("top.lower")).cast("int").alias("__majority"))
    return numbered.join(change, by, "left").select(
        *keys, at, "word", F.coalesce("__majority", "speaker").alias("speaker")
    )


def sentence_rows(words: DataFrame, keys: Sequence[str] = KEYS, at: str = "at", rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per sentence and speaker: a new one begins after ``.``, ``?``, ``!`` or when the
    speaker changes."""
    near = neighbours(words, keys, at, prev={"__ps": F.col("speaker"), "__pw": F.col("word")}, rows=rows)
    opens = F.col("__ps").isNull() | (F.col("__ps") != F.col("speaker")) | F.col("__pw").rlike(SENTENCE_END)
    runs = run_ids(near, keys, at, opens, name="sentence", rows=rows)
    pieces = runs.groupBy(*keys, "sentence", row_block(at, rows).alias("__block")).agg(
        F.min(at).alias(at),
        F.min("speaker").alias("speaker"),
        F.min_by("start", at).alias("start"),
        F.max_by("end", at).alias("end"),
        join_text("word", [at], " ").alias("text"),
    )
    return pieces.groupBy(*keys, "sentence").agg(
        F.concat(F.lit("Speaker "), F.min("speaker").cast("string")).alias("speaker"),
        F.min_by("start", at).alias("start"),
        F.max_by("end", at).alias("end"),
        F.concat(join_text("text", [at], " "), F.lit(" ")).alias("text"),
    )
