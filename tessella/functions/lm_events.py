"""Fixed-width event text: four columns or four tokens per event.

Columns are event, value, duration and offset; times above 255 bins move to
extension rows (EXD, EXO) before the event, as high and low byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions.events import name_pitch, pitch_name

# Event names by kind, with the older aliases.
STRUCTURAL = {"H": "H", "M": "M", "PHRASE": "H", "BAR": "M"}
PEDALS = {"P": "P", "P1": "P1", "P2": "P2", "PED_SUS": "P", "PED_SOFT": "P1", "PED_SOS": "P2"}
EXTENSIONS = ("EXD", "EXO")
ANNOTATIONS = ("A", "AL", "OR", "ORL", "D", "DL", "RS", "RSL", "RE", "REL", "EX", "EXL", "FM", "PM", "TP", "MT", "KS")
NOTE = r"^[A-G]#?-?[0-9]+L?$"


def kind(event: Column) -> Column:
    """structural, pedal, extension, annotation, note, or null."""
    return (
        F.when(event.isin(*STRUCTURAL), "structural")
        .when(event.isin(*PEDALS), "pedal")
        .when(event.isin(*EXTENSIONS), "extension")
        .when(event.isin(*ANNOTATIONS), "annotation")
        .when(event.rlike(NOTE), "note")
    )


def canonical(event: Column) -> Column:
    """Event name without the older aliases."""
    names = {k: v for k, v in (STRUCTURAL | PEDALS).items() if k != v}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[event], event)


def row_error(event: Column, value: Column, duration: Column, offset: Column) -> Column:
    """Why a row of four text columns is invalid; null if it is valid."""
    u7 = lambda c: F.coalesce(c.try_cast("int").between(0, 127), F.lit(False))
    u8 = lambda c: F.coalesce(c.try_cast("int").between(0, 255), F.lit(False))
    k = kind(event)
    return (
        F.when(k.isNull(), "unknown event")
        .when((k == "note") & name_pitch(event).isNull(), "pitch out of range")
        .when((k == "extension") & (value != "0"), "extension value must be 0")
        .when((k != "extension") & ~u7(value), "value out of range")
        .when((k == "pedal") & (duration != "0"), "pedal duration must be 0")
        .when(~u8(duration) & ~((k == "note") & (duration == "EXT")), "duration out of range")
        .when(~u8(offset) & ~(k.isin("note", "pedal") & (offset == "EXT")), "offset out of range")
    )


def _t(kind_: str, value: Column) -> Column:
    return F.format_string(f"<{kind_}%03d>", value.cast("int"))


def row_tokens(event: Column, value: Column, duration: Column, offset: Column) -> Column:
    """Tokens of a semantic event (integer columns, times up to 65535), extensions first."""
    k, name = kind(event), canonical(event)
    long_duration, long_offset = (k == "note") & (duration > 255), k.isin("note", "pedal") & (offset > 255)

    def extension(label: str, v: Column) -> Column:
        return F.array(F.lit(f"<{label}>"), F.lit("<NIL>"), _t("T", F.floor(v / 256)), _t("T", v % 256))

    nothing = F.expr("cast(array() as array<string>)")
    first = F.when(k == "note", _t("N", name_pitch(event))).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
    third = F.when(k == "pedal", F.lit("<NIL>")).when(long_duration, F.lit("<EXT>")).otherwise(_t("T", duration))
    main = F.array(first, _t("V", value), third, F.when(long_offset, F.lit("<EXT>")).otherwise(_t("T", offset)))
    return F.concat(F.when(long_duration, extension("EXD", duration)).otherwise(nothing), F.when(long_offset, extension("EXO", offset)).otherwise(nothing), main)


def piece_text(rows: DataFrame, key: list[str], order: list[str], wrap: bool = True) -> DataFrame:
    """Token text per piece from rows with a ``tokens`` array."""
    item = F.struct(*order, F.array_join("tokens", "").alias("_t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_t"]), "")
    text = F.concat(F.lit("<MIDI>"), joined, F.lit("</MIDI>")) if wrap else joined
    return rows.groupBy(*key).agg(text.alias("text"))


def decode(pieces: DataFrame, key: list[str], text: str) -> DataFrame:
    """Events of token texts: key, pos, event, value, duration, offset, error.

    Tokens are taken by fours; extensions go to the event that follows them. A
    trailing part of less than four tokens is an event with an error.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit("<[^<>]+>"), F.lit(0)), lambda t: ~t.isin("<MIDI>", "</MIDI>", "<EOS_MIDI>"))
    fours = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("_all") / 4) - 1)), lambda i: F.slice("_all", (i * 4 + 1).cast("int"), 4))
    rows = pieces.select(*key, tokens.alias("_all")).where("size(_all) > 0").select(*key, F.posexplode(fours).alias("pos", "q"))
    number = lambda i: F.regexp_extract(F.coalesce(F.get("q", F.lit(i)), F.lit("")), "^<[TVN]([0-9]{3})>$", 1).try_cast("int")
    w = W.partitionBy(*key).orderBy("pos")
    head = F.regexp_replace(F.col("q")[0], "[<>]", "")
    parsed = rows.withColumn("head", head).withColumn("ext", number(2) * 256 + number(3))
    one, two = F.lag("head").over(w), F.lag("head", 2).over(w)
    x1, x2 = F.lag("ext").over(w), F.lag("ext", 2).over(w)
    parsed = parsed.withColumn("_d", F.when(one == "EXD", x1).when((one == "EXO") & (two == "EXD"), x2)).withColumn("_o", F.when(one == "EXO", x1).when((one == "EXD") & (two == "EXO"), x2))
    note = F.col("head").rlike("^N[0-9]{3}$")
    nil = F.when(F.col("q")[2] == "<NIL>", F.lit(0))
    duration = F.coalesce(F.when(F.get("q", F.lit(2)) == "<EXT>", F.col("_d")), number(2), nil)
    offset = F.coalesce(F.when(F.get("q", F.lit(3)) == "<EXT>", F.col("_o")), number(3))
    error = F.when(F.size("q") < 4, "incomplete").when(offset.isNull() | duration.isNull(), "missing extension")
    return (
        parsed.where(~F.col("head").isin(*EXTENSIONS))
        .withColumn("event", F.when(note, pitch_name(F.substring("head", 2, 3).try_cast("int"))).otherwise(F.col("head")))
        .select(*key, "pos", "event", number(1).alias("value"), duration.alias("duration"), offset.alias("offset"), F.when(F.size("q") < 4, "incomplete").otherwise(error).alias("error"))
    )


def decode_with_repairs(pieces: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Decode damaged token texts: events (key, pos, event, value, duration, offset) and one row of counts per piece.

    The counts are those of ``repair_counts``, without its sums; a caller that
    needs no events takes them from there.
    """
    return _decoded(pieces, key, text).where("_valid").select(*key, "pos", "event", "value", "duration", "offset"), repair_counts(pieces, key, text).drop("duration", "total_offset")


def repair_counts(pieces: DataFrame, key: list[str], text: str) -> DataFrame:
    """Counts of what decoding a damaged token text met, and the sums ``duration`` and ``total_offset`` of its events, in one pass: a row per piece.

    Tokens are taken by fours; what is left over is dropped (``dangling``). A
    four that is no event is left out and counted (``invalid``). An extension
    waits for the next event that asks for it, whatever comes between; one that
    asks without a waiting one gets 255 (``missing_duration``,
    ``missing_offset``). Counts: tokens, dangling, extensions, structural,
    pedals, notes, invalid and the two kinds of repair. Pieces without tokens
    have zero counts; a null text has no tokens. ``key`` names a piece.
    """
    valid, four = F.col("_valid"), F.col("pos").isNotNull()
    return _decoded(pieces, key, text).groupBy(*key).agg(
        F.max("_tokens").alias("tokens"), F.max("_dangling").alias("dangling"),
        F.count_if("extension").alias("extensions"), F.count_if(valid & F.col("marker")).alias("structural"), F.count_if(valid & F.col("pedal")).alias("pedals"), F.count_if(valid & F.col("_note")).alias("notes"),
        F.count_if(four & ~valid & ~F.col("extension")).alias("invalid"), F.count_if("no_d").alias("missing_duration"), F.count_if("no_o").alias("missing_offset"),
        *[F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0)).cast("long").alias(n) for c, n in (("duration", "duration"), ("offset", "total_offset"))],
    )


def _decoded(pieces: DataFrame, key: list[str], text: str) -> DataFrame:
    """Fours of the tokens of each piece, read: event, times and flags; a piece without a four has a row without ``pos``."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("<[^<>]+>"), F.lit(0)), lambda t: ~t.isin("<MIDI>", "</MIDI>", "<EOS_MIDI>"))
    tokens = pieces.select(*key, found.alias("_all"))
    whole = F.floor(F.size("_all") / 4).cast("int")
    fours = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.slice("_all", i * 4 + 1, 4)))
    sizes = (F.size("_all").cast("long").alias("_tokens"), (F.size("_all") % 4).cast("long").alias("_dangling"))
    rows = tokens.select(*key, *sizes, F.posexplode_outer(fours).alias("pos", "q"))

    def number(place: int, letter: str, most: int):
        value = F.regexp_extract(F.get("q", F.lit(place)), f"^<{letter}([0-9]{{3}})>$", 1).try_cast("int")
        return F.when(value <= most, value)

    read = rows.select(
        *key, "pos", "_tokens", "_dangling", F.regexp_replace(F.col("q")[0], "[<>]", "").alias("head"), number(0, "N", 127).alias("pitch"), number(1, "V", 127).alias("value"),
        (F.col("q")[1] == "<NIL>").alias("no_value"), (F.col("q")[2] == "<NIL>").alias("no_duration"), number(2, "T", 255).alias("high"), number(3, "T", 255).alias("low"),
        (F.col("q")[2] == "<EXT>").alias("asks_duration"), (F.col("q")[3] == "<EXT>").alias("asks_offset"),
    )
    pair = F.col("high") * 256 + F.col("low")
    extends = F.col("head").isin(*EXTENSIONS) & F.col("no_value") & pair.isNotNull()
    marker = F.col("head").isin("H", "M") & F.col("value").isNotNull() & pair.isNotNull()
    pedal = F.col("head").isin("P", "P1", "P2") & F.col("value").isNotNull() & F.col("no_duration")
    note = F.col("pitch").isNotNull() & F.col("value").isNotNull()
    kinds = read.withColumn("_extends", extends).withColumn("_note", note).withColumn("_takes_offset", note | pedal)
    before = W.partitionBy(*key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)

    def waiting(name: str, asks):
        # The last event that set or took the extension: a struct, so that "taken" is told from "unchanged".
        change = F.when(F.col("_extends") & (F.col("head") == name), F.struct(pair.alias("v"))).when(asks, F.struct(F.lit(None).cast("int").alias("v")))
        return F.last(change, ignorenulls=True).over(before)["v"]

    takes_duration, takes_offset = F.col("_note") & F.col("asks_duration"), F.col("_takes_offset") & F.col("asks_offset")
    timed = kinds.withColumn("_d", waiting("EXD", takes_duration)).withColumn("_o", waiting("EXO", takes_offset))
    duration = F.when(marker, pair).when(F.col("_note"), F.when(F.col("asks_duration"), F.coalesce("_d", F.lit(255))).otherwise(F.col("high"))).when(pedal, 0)
    offset = F.when(marker, 0).when(F.col("_takes_offset"), F.when(F.col("asks_offset"), F.coalesce("_o", F.lit(255))).otherwise(F.col("low")))
    event = F.when(F.col("_note"), pitch_name(F.col("pitch"))).when(marker | pedal, F.col("head"))
    made = timed.select(
        *key, "pos", "_tokens", "_dangling", event.alias("event"), "value", duration.alias("duration"), offset.alias("offset"), F.col("_extends").alias("extension"), marker.alias("marker"), pedal.alias("pedal"), "_note",
        (takes_duration & F.col("_d").isNull()).alias("no_d"), (takes_offset & F.col("_o").isNull()).alias("no_o"),
    )
    return made.withColumn("_valid", F.col("event").isNotNull() & F.col("duration").isNotNull() & F.col("offset").isNotNull())


def full_vocabulary() -> list[str]:
    """All symbols of the performance vocabulary, by rule."""
    numbered = [f"<{k}{i:03d}>" for k, n in (("N", 128), ("V", 128), ("T", 256)) for i in range(n)]
    return [*numbered, "<P>", "<P1>", "<P2>", "<M>", "<H>", "<EXD>", "<EXO>", "<NIL>", "<EXT>", "<MIDI>", "</MIDI>", "<EOS_MIDI>"]


