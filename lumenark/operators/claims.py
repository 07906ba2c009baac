"""Claims: which observations become searchable text, labels, and claim rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Kinds kept out of the text index.
REFUSED_KINDS = """
palette text_region beat_grid loudness_curve words freeze likes comments comments_captured
declared_duration caption_length caption_words object_count screen_share face_track
""".split()

# Kinds that already are language.
PROSE_KINDS = """
transcript segment caption hashtag mention uploader screen_text text keyphrase
hook_opening_line hook_words agreement contested language_uncertain
""".split()

# The statement a measured value is written into.
TEMPLATES = {
    "dominant_colour": "the dominant colour is {v}",
    "camera_move": "camera {v}",
    "shot_scale": "{v} shot",
    "face_scale": "a {v} view of a face",
    "brightness": "{v} lighting",
    "saturation": "{v} colours",
    "temperature": "{v} tones",
    "sharpness": "{v} focus",
    "rhythm": "{v} cutting rhythm",
    "acceleration": "the pace {v}",
    "key": "in the key of {v}",
    "hook_form": "the opening is a {v}",
    "language": "spoken in {v}",
    "object": "{v}",
    "sound_event": "{v}",
    "silence": "{v}",
    "exposure": "{v}",
    "music_presence": "{v}",
}

# ISO 639-1 codes spelled out.
LANGUAGES = {
    "en": "English", "hi": "Hindi", "ja": "Japanese", "ko": "Korean", "es": "Spanish",
    "fr": "French", "de": "German", "pt": "Portuguese", "ru": "Russian", "ar": "Arabic",
    "zh": "Chinese", "it": "Italian", "bn": "Bengali", "pa": "Punjabi", "ta": "Tamil",
    "te": "Telugu", "mr": "Marathi", "gu": "Gujarati", "ur": "Urdu", "id": "Indonesian",
    "tr": "Turkish", "vi": "Vietnamese", "th": "Thai", "nl": "Dutch", "pl": "Polish",
    "uk": "Ukrainian", "fa": "Persian", "ml": "Malayalam", "kn": "Kannada", "ne": "Nepali",
    "he": "Hebrew", "sv": "Swedish",
}

# Confidence floor, widest label, function words no label list contains.
FLOOR = 0.05
LABEL_WORDS = 4
FUNCTION_WORDS = """
a an the and or of in on at to for with by from is are was were am be been being this that
these those it its his her their our my your as but if then than there here into onto over
under about not no while when where who which he she they them we you i has have had do does
did will would can could
""".split()


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def is_number(v: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.replace(v, F.lit(","), F.lit("")), r"%+$", ""))
    return bare.rlike(r"(?i)^[+-]?((\d+(_\d+)*)?\.?(\d+(_\d+)*)(e[+-]?\d+)?|\d+\.(e[+-]?\d+)?|inf|infinity|nan)$")


def leads_with_number(v: Column) -> Column:
    return v.rlike(r"^[-+~<>≈ ]*\d")


def is_structure(v: Column) -> Column:
    return v.rlike(r"^[{\[#<]")


def written(kind: Column, value: Column, confidence: Column) -> Column:
    """struct(form, text): ``fact`` or ``prose``, NULL when kept out of the text index."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    raw = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    v = F.when(k == "language", F.coalesce(F.try_element_at(_literal_map(LANGUAGES), F.lower(raw)), raw)).otherwise(raw)
    template = F.try_element_at(_literal_map(TEMPLATES), k)
    label = F.size(F.split(v, r"\s+")) <= LABEL_WORDS
    own = F.concat(F.trim(F.replace(k, F.lit("_"), F.lit(" "))), F.lit(" "), v)
    fact = T.squeeze(F.coalesce(F.replace(template, F.lit("{v}"), v), own))
    out = lambda form, text: F.struct(F.lit(form).alias("form"), text.alias("text"))
    nothing = F.lit(None).cast("struct<form:string,text:string>")
    return (F.when((raw == "") | k.isin(*REFUSED_KINDS) | F.coalesce(confidence < FLOOR, F.lit(False)), nothing)
            .when(k.isin(*PROSE_KINDS), F.when(~T.is_absence(raw), out("prose", raw)))
            .when(is_structure(v) | is_number(v) | leads_with_number(v) | T.is_absence(v), nothing)
            .when(template.isNull() & ~label, out("prose", v))
            .otherwise(out("fact", fact)))


def admit(claims: DataFrame, kind: str = "kind", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """Claims that enter the text index, with ``form`` and ``text``; the rest are dropped."""
    w = claims.withColumn("__w", written(F.col(kind), F.col(value), F.col(confidence)))
    return w.filter(F.col("__w").isNotNull()).select(*claims.columns, "__w.form", "__w.text")


_EDGE = r"^['’\-/&+ ]+|['’\-/&+ ]+$"


def bare_labels(cell: Column) -> Column:
    """``3× cow, person`` as label structs; empty when the cell reads like prose."""
    s = F.trim(cell)
    words = F.transform(F.split(F.replace(s, F.lit(","), F.lit(" ")), r"\s+"),
                        lambda w: F.lower(F.regexp_replace(w, r"^['’\-/&+]+|['’\-/&+]+$", "")))
    prose = F.exists(words, lambda w: w.isin(*FUNCTION_WORDS))
    parts = F.transform(F.split(s, ","), lambda p: F.regexp_replace(
        F.trim(F.regexp_replace(p, r"(?i)^\s*\d+\s*[×x]\s*", "")), _EDGE, ""))
    pieces = lambda p: F.filter(F.split(p, r"\s+"), lambda x: x != "")
    counting = lambda p: F.forall(pieces(p), lambda x: F.regexp_replace(x, r"^[×x]+|[×x]+$", "").rlike(r"^\d*$"))
    real = F.filter(parts, lambda p: ~counting(p))
    bad = F.exists(real, lambda p: (F.size(pieces(p)) > 3) | (F.length(p) < 2))
    shape = (F.length(s) > 0) & (F.length(s) <= 120) & s.rlike(r"(?U)^[\w×\s,'’\-/&+]+$")
    good = shape & ~prose & ~bad & (F.size(real) > 0) & (F.size(real) <= 8)
    return F.when(good, F.transform(real, lambda p: F.struct(
        F.lower(F.array_join(pieces(p), " ")).alias("label"), F.lit(None).cast("double").alias("conf"))))


def json_labels(cell: Column) -> Column:
    """A JSON list of strings or label objects; empty when any item is something else."""
    items = F.from_json(cell, "array<variant>")

    def one(v):
        is_text = F.schema_of_variant(v) == "STRING"
        pick = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])
        label = F.when(is_text, F.try_variant_get(v, "$", "string")).otherwise(
            F.coalesce(F.nullif(pick("label"), F.lit("")), F.nullif(pick("name"), F.lit("")), pick("class")))
        conf = F.when(~is_text, F.coalesce(*[F.try_variant_get(v, f"$.{n}", "double") for n in ("conf", "confidence", "score")]))
        return F.struct(F.lower(F.trim(F.coalesce(label, F.lit("")))).alias("label"), conf.alias("conf"))

    known = F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(STRING|OBJECT)"), F.lit(False)))
    rows = F.transform(items, one)
    fits = F.forall(rows, lambda r: (r["label"] != "") & (F.size(F.split(r["label"], r"\s+")) <= LABEL_WORDS))
    return F.when(items.isNotNull() & known & fits & (F.size(items) > 0), rows)


def labels(cell: Column) -> Column:
    """array<struct<label, conf>> if the cell is a detector's label list, else NULL."""
    s = F.trim(cell)
    return F.when(s.startswith("["), json_labels(s)).otherwise(bare_labels(s))


def label_column(df: DataFrame, column: str, share: float = 0.6, minimum: int = 20) -> DataFrame:
    """One row (considered, labelish, is_label): do the column's cells hold labels? All of them are asked."""
    cell = F.col(column).cast("string")
    seen = df.select(cell.alias("c")).filter(
        F.col("c").isNotNull() & (F.trim("c") != "") & ~T.is_absence(F.col("c")))
    return (seen.agg(F.count("*").alias("considered"),
                     F.count_if(F.coalesce(F.size(labels(F.col("c"))), F.lit(0)) > 0).alias("labelish"))
            .withColumn("is_label", (F.col("considered") >= minimum)
                        & (F.col("labelish") / F.greatest(F.col("considered"), F.lit(1)) >= share)))


CLAIM_SCHEMA = (
    "uid STRING, entity_key STRING, shot_idx INT, t0 DOUBLE, t1 DOUBLE, channel STRING, kind STRING, "
    "value STRING, num DOUBLE, confidence DOUBLE, observer_id STRING, ordinal INT, frame_idx INT, frame_hi INT")


def uid(*parts: Column) -> Column:
    """Stable row id over its parts; NULL and empty differ from each other in no reader."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def observer_id(component: str, config_json: str = "") -> str:
    import hashlib
    return f"{component}@{hashlib.sha256(config_json.encode()).hexdigest()[:12]}"


def to_claim_rows(emissions: DataFrame, observer: str, coverage: Column | None = None) -> DataFrame:
    """Emitted observations in the claim shape, confidence scaled by decode coverage."""
    have = set(emissions.columns)
    pick = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    conf = F.coalesce(pick("confidence", "double"), F.lit(1.0))
    if coverage is not None:
        conf = F.round(conf * F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage)), 4)
    key, chan, kind = pick("entity_key", "string"), pick("channel", "string"), pick("kind", "string")
    t0 = F.coalesce(pick("t0", "double"), pick("frame_t", "double"))
    t1 = F.coalesce(pick("t1", "double"), pick("frame_t1", "double"))
    return emissions.select(
        uid(key, F.lit(observer), chan, kind, pick("shot_idx", "int"), pick("frame_idx", "int"),
            pick("ordinal", "int"), pick("value", "string")).alias("uid"),
        key.alias("entity_key"), pick("shot_idx", "int").alias("shot_idx"), t0.alias("t0"), t1.alias("t1"),
        chan.alias("channel"), kind.alias("kind"), pick("value", "string").alias("value"),
        pick("num", "double").alias("num"), conf.alias("confidence"), F.lit(observer).alias("observer_id"),
        pick("ordinal", "int").alias("ordinal"), pick("frame_idx", "int").alias("frame_idx"),
        pick("frame_hi", "int").alias("frame_hi"))


def text_bundle(claims: DataFrame, keys=("entity_key",)) -> DataFrame:
    """(keys, part, position, value): everything sayable about an entity, in claim order.

    Kept as ordered rows: a bundle of one entity may be as large as the entity.
    """
    part = (F.when((F.col("channel") == "speech") & (F.col("kind") == "segment"), "transcript")
            .when((F.col("channel") == "ocr") & (F.col("kind") == "text"), "on_screen")
            .when((F.col("channel") == "caption") & F.col("kind").isin("caption", "hashtag", "comment"), F.col("kind"))
            .when((F.col("channel") == "visual") & (F.col("kind") == "shot_description"), "descriptions"))
    return (claims.withColumn("part", part).filter(F.col("part").isNotNull() & (F.coalesce("value", F.lit("")) != ""))
            .select(*keys, "part", F.coalesce("shot_idx", F.lit(-1)).alias("shot_idx"), "t0", "ordinal", "value"))


def extract(df: DataFrame, extractor, schema: str = "entity_key string, channel string, kind string, value string, num double") -> DataFrame:
    """User extension point: ``extractor(pandas rows of one key batch) -> claim rows``.

    Rows reach the callable in Arrow batches, so a hot key is never materialised whole; the
    callable must be row- or batch-local.
    """
    def run(batches):
        for pdf in batches:
            yield extractor(pdf)

    return df.mapInPandas(run, schema)
