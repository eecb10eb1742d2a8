"""Turkish query text as column expressions: time windows, object classes, intent, translation.

Everything is built from native functions, so a query table is parsed inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. The time phrases, in the order in which they are tried: name, pattern.
_L = r"[\p{L}\p{N}_]"
TIME_PHRASES = (
    ("clock", rf"(dün\s+)?saat\s+(\d{{1,2}})(?::(\d{{2}}))?(?:'?{_L}*)?\s*(?:civarı(?:nda)?|gibi|sularında|sıralarında)?"),
    ("last_hours", rf"son\s+(\d+)\s+saat{_L}*"),
    ("last_minutes", rf"son\s+(\d+)\s+dakika{_L}*"),
    ("last_night", rf"dün\s+gece{_L}*"),
    ("yesterday_morning", rf"dün\s+sabah{_L}*"),
    ("yesterday_noon", rf"dün\s+öğle{_L}*"),
    ("yesterday_evening", rf"dün\s+akşam{_L}*"),
    ("yesterday", rf"(?:^|[^\p{{L}}\p{{N}}_])dün(?:$|[^\p{{L}}\p{{N}}_])"),
    ("tonight", rf"bu\s+gece{_L}*"),
    ("this_morning", rf"bu\s+sabah{_L}*"),
    ("this_evening", rf"bu\s+akşam{_L}*"),
    ("today", rf"(?:^|[^\p{{L}}\p{{N}}_])bugün(?:$|[^\p{{L}}\p{{N}}_])"),
)
# Fixed values. Hours from the midnight of today at which the day phrases begin and end.
DAY_HOURS = {
    "last_night": (-4, 6), "yesterday_morning": (-19, -12), "yesterday_noon": (-13, -9), "yesterday_evening": (-7, -1),
    "yesterday": (-24, 0), "tonight": (20, 30), "this_morning": (5, 12), "this_evening": (17, 23),
}
CLOCK_MINUTES = 45
# Fixed values. Words without visual meaning.
FILLERS = r"bul|göster|ara|listele|getir|bana|acaba|var\s*mı(?:ydı)?|ne\s*zaman|kaçta|hangi\s+saatte"
# Fixed values. Roots of object classes in the order in which they are tried, and short whole words.
CLASS_ROOTS = (
    ("insan", "insan"), ("adam", "insan"), ("kisi", "insan"), ("kadin", "insan"), ("erkek", "insan"), ("cocuk", "insan"),
    ("yaya", "insan"), ("surucu", "insan"), ("bisiklet", "bisiklet"), ("araba", "araba"), ("otomobil", "araba"),
    ("sedan", "araba"), ("motosiklet", "motosiklet"), ("motorsiklet", "motosiklet"), ("otobus", "otobüs"),
    ("minibus", "otobüs"), ("midibus", "otobüs"), ("kamyonet", "kamyon"), ("kamyon", "kamyon"),
)
CLASS_WORDS = (("suv", "araba"), ("tir", "kamyon"), ("tira", "kamyon"))
VEHICLE_ROOTS = ("arac", "vasita", "tasit")
SCENE_ROOTS = (
    "otopark", "garaj", "cadde", "sokak", "kavsak", "kampus", "otoyol", "otoban", "kaldirim", "meydan", "bahce", "avlu",
    "koridor", "merdiven", "peron", "durak", "giris", "cikis", "bina", "alan", "yol", "manzara", "sahne", "goruntu",
    "kamera", "kayit",
)
CASE_ENDINGS = (
    "da", "de", "ta", "te", "dan", "den", "tan", "ten", "la", "le", "yla", "yle", "in", "un", "nin", "nun", "nda", "nde",
    "ndan", "nden",
)
# Fixed values. Roots and their English, in the order in which they are tried, and words without any.
ENGLISH = (
    ("insan", "person"), ("adam", "man"), ("kadin", "woman"), ("cocuk", "child"), ("kisi", "person"),
    ("yaya", "pedestrian"), ("surucu", "driver"), ("bebek", "baby"), ("araba", "car"), ("otomobil", "car"),
    ("kamyonet", "pickup truck"), ("kamyon", "truck"), ("otobus", "bus"), ("minibus", "minibus"),
    ("motosiklet", "motorcycle"), ("bisiklet", "bicycle"), ("kopek", "dog"), ("kedi", "cat"), ("suv", "SUV"),
    ("siyah", "black"), ("beyaz", "white"), ("mavi", "blue"), ("kirmizi", "red"), ("sari", "yellow"), ("yesil", "green"),
    ("gri", "gray"), ("gumus", "silver"), ("koyu", "dark"), ("turuncu", "orange"), ("mor", "purple"),
    ("kahverengi", "brown"), ("pembe", "pink"), ("lacivert", "navy blue"), ("otopark", "parking lot"),
    ("garaj", "garage"), ("cadde", "street"), ("sokak", "street"), ("kavsak", "intersection"), ("kampus", "campus"),
    ("otoyol", "highway"), ("yol", "road"), ("kaldirim", "sidewalk"), ("meydan", "square"), ("bina", "building"),
    ("durak", "bus stop"), ("gece", "at night"), ("gunduz", "during day"), ("yagmur", "rain"), ("kar", "snow"),
    ("semsiye", "umbrella"), ("trafik", "traffic"), ("yuruyen", "walking"), ("kosan", "running"), ("giden", "moving"),
    ("duran", "stopped"), ("park", "parked"), ("telefon", "phone"), ("bosaltan", "unloading"), ("bekleyen", "waiting"),
    ("arac", "vehicle"), ("tasit", "vehicle"), ("gezdiren", "walking"), ("suren", "riding"), ("binen", "boarding"),
    ("konus", "talking"), ("kapli", "covered"), ("tasiyan", "carrying"), ("iten", "pushing"),
)
SKIPPED = (
    "ve", "ile", "bir", "bu", "su", "cok", "dolu", "olan", "halindeki", "arasinda", "gecen", "giren", "cikan", "ustunde",
    "yaninda", "onunde", "arkasinda", "renkli",
)
#: Roots of colours, and of things that need a look.
COLOR_ROOTS = (
    "siyah", "beyaz", "mavi", "kirmizi", "sari", "yesil", "gri", "gumus", "koyu", "turuncu", "mor", "kahverengi", "pembe",
    "lacivert",
)
HARD_ROOTS = ("kopek", "kedi", "yagmur", "kar", "semsiye", "semsiy")
#: Letters folded to ASCII, and what is stripped from a token's ends.
FOLD = ("çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")
EDGE = r"""^[.,;:!?()\[\]"']+|[.,;:!?()\[\]"']+$"""


# ---- text ----


def lower_tr(q: Column) -> Column:
    """Trimmed and lower-cased by Turkish rules for the letter i."""
    return F.lower(F.translate(F.trim(q), "İI", "iı"))


def fold(q: Column) -> Column:
    """ASCII letters for Turkish ones, in lower case."""
    return F.lower(F.translate(q, *FOLD))


def raw_tokens(q: Column) -> Column:
    return F.filter(F.split(fold(q), r"\s+"), lambda t: t != "")


def tokens(q: Column) -> Column:
    """Folded tokens without punctuation at their ends."""
    return F.filter(F.transform(raw_tokens(q), lambda t: F.regexp_replace(t, EDGE, "")), lambda t: t != "")


def _starts(t: Column, roots) -> Column:
    return t.rlike(f"^(?:{'|'.join(roots)})")


def _first(t: Column, table) -> Column:
    """Value of the first root of ``table`` that the token begins with; null for none.

    One regular expression for all roots: alternatives are tried in the order of the table.
    """
    values = F.create_map(*[F.lit(x) for row in dict(reversed(table)).items() for x in row])
    return F.try_element_at(values, F.regexp_extract(t, f"^({'|'.join(r for r, _ in table)})", 1))


def _class_of(t: Column) -> Column:
    return F.coalesce(_first(t, CLASS_ROOTS), _word(t, CLASS_WORDS))


def _word(t: Column, table) -> Column:
    return F.coalesce(*[F.when(t == w, v) for w, v in table])


# ---- time ----


def parse_time(queries: DataFrame, raw: str = "raw_query", now: str = "now") -> DataFrame:
    """Adds ``time_phrase``, ``ts_from``, ``ts_to`` (seconds, closed at both ends) and ``visual_text``.

    The first phrase of the list that occurs anywhere counts, and once.  ``now`` is a timestamp.  Times are
    those of the session's wall clock, on days with a clock change too.
    """
    q = lower_tr(F.col(raw))
    at_now, midnight = F.col(now).cast("timestamp_ntz"), F.to_date(F.col(now)).cast("timestamp_ntz")

    def wall(base, later=None):
        if later is not None:
            base = base + F.make_dt_interval(secs=(later if isinstance(later, Column) else F.lit(later)).cast("decimal(18,6)"))
        return F.unix_micros(base.cast("timestamp")) / 1e6

    kind = F.coalesce(*[F.when(q.rlike(p), name) for name, p in TIME_PHRASES])
    df = queries.withColumns({"__q": q, "__kind": kind})
    of = lambda name, g: F.regexp_extract("__q", dict(TIME_PHRASES)[name], g)
    number = lambda name, g=1: F.expr("1.0D") * F.coalesce(F.nullif(of(name, g), F.lit("")).cast("double"), F.lit(0.0))
    center = number("clock", 2) * 3600 + number("clock", 3) * 60 - F.when(of("clock", 1) != "", 86400.0).otherwise(0.0)
    spans = {
        "clock": (wall(midnight, center - CLOCK_MINUTES * 60), wall(midnight, center + CLOCK_MINUTES * 60)),
        "last_hours": (wall(at_now, number("last_hours") * -3600), wall(at_now)),
        "last_minutes": (wall(at_now, number("last_minutes") * -60), wall(at_now)),
        "today": (wall(midnight), wall(at_now)),
    } | {k: (wall(midnight, a * 3600.0), wall(midnight, b * 3600.0)) for k, (a, b) in DAY_HOURS.items()}
    pick = lambda i: F.coalesce(*[F.when(F.col("__kind") == k, v[i]) for k, v in spans.items()])
    phrase = F.coalesce(*[F.when(F.col("__kind") == n, F.regexp_extract("__q", p, 0)) for n, p in TIME_PHRASES])
    bare = F.trim(F.regexp_replace(phrase, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_']+$", ""))
    place = F.instr(F.col("__q"), phrase)
    without = F.when(phrase.isNull(), F.col("__q")).otherwise(
        F.concat(F.substring("__q", F.lit(1), place - 1), F.lit(" "), F.substring(F.col("__q"), place + F.length(phrase), F.length("__q")))
    )
    b = r"(?<![\p{L}\p{N}_])"
    clean = F.regexp_replace(without, rf"{b}(?:{FILLERS})(?![\p{{L}}\p{{N}}_])", " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r"[?!.,;]+", " "), r"\s+", " "))
    return df.withColumns({"time_phrase": bare, "ts_from": pick(0), "ts_to": pick(1), "visual_text": clean}).drop("__q", "__kind")


# ---- objects and intent ----


def required_classes(text: Column) -> Column:
    """Sorted distinct object classes that the text names."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(tokens(text), _class_of))))


def generic_vehicle(text: Column) -> Column:
    """The text names vehicles without saying which."""
    return F.exists(tokens(text), lambda t: _class_of(t).isNull() & _starts(t, VEHICLE_ROOTS))


def _token_kind(t: Column) -> Column:
    """``object`` or ``scene``, if the token is one and carries no case ending; else null."""
    tail = [(r, "object") for r in VEHICLE_ROOTS] + [(r, "scene") for r in SCENE_ROOTS]
    # a root that matches settles the token, so a token in an oblique case gives "adjunct"

    def by_root(rows) -> Column:
        root = F.regexp_extract(t, f"^({'|'.join(r for r, _ in rows)})", 1)
        rest = F.substring(t, F.length(root) + 1, F.length(t))
        kind = F.try_element_at(F.create_map(*[F.lit(x) for row in rows for x in row]), root)
        return F.when(root != "", F.when(rest.rlike(f"(?:{'|'.join(CASE_ENDINGS)})$"), "adjunct").otherwise(kind))

    classes = [(r, "object") for r, _ in CLASS_ROOTS]
    return F.coalesce(by_root(classes), _word(t, [(w, "object") for w, _ in CLASS_WORDS]), by_root(tail))


def intent(text: Column) -> Column:
    """``scene``, ``object`` or ``neutral``: the kind of the last word that is neither in an oblique
    case nor without kind."""
    kinds = F.filter(F.transform(tokens(text), _token_kind), lambda k: k.isNotNull() & (k != "adjunct"))
    return F.coalesce(F.try_element_at(kinds, F.lit(-1)), F.lit("neutral"))


def has_color(text: Column) -> Column:
    return F.exists(raw_tokens(text), lambda t: _starts(t, COLOR_ROOTS))


def needs_verification(text: Column) -> Column:
    return F.exists(raw_tokens(text), lambda t: _starts(t, COLOR_ROOTS + HARD_ROOTS))


# ---- translation ----


def translate_visual(text: Column) -> Column:
    """English words for Turkish ones by root; unknown words stay, empty words go, an empty result is
    the text itself."""
    words = F.filter(tokens(text), lambda t: ~t.isin(*SKIPPED))
    out = F.array_join(F.transform(words, lambda t: F.coalesce(_first(t, ENGLISH), t)), " ")
    return F.when(F.size(words) > 0, out).otherwise(text)


def color_en(text: Column) -> Column:
    """The first colour, in English."""
    return _first(F.try_element_at(F.filter(tokens(text), lambda t: _starts(t, COLOR_ROOTS)), F.lit(1)), ENGLISH)


def object_en(text: Column) -> Column:
    """What to look for, in English: the first hard concept, else the last class noun (``object`` if it
    has no English), else ``vehicle``; null for none."""
    hard = F.try_element_at(F.filter(tokens(text), lambda t: _starts(t, HARD_ROOTS)), F.lit(1))
    noun = F.try_element_at(F.filter(tokens(text), lambda t: _class_of(t).isNotNull()), F.lit(-1))
    some = F.exists(tokens(text), lambda t: _starts(t, VEHICLE_ROOTS))
    return F.coalesce(
        _first(hard, ENGLISH),
        F.when(noun.isNotNull(), F.coalesce(_first(noun, ENGLISH), F.lit("object"))),
        F.when(some, "vehicle"),
    )


def parse(queries: DataFrame, raw: str = "raw_query", now: str = "now") -> DataFrame:
    """All parsed columns.  Where nothing visual is left, the raw query stands in for the text."""
    df = parse_time(queries, raw, now)
    text = F.when(F.col("visual_text") == "", F.col(raw)).otherwise(F.col("visual_text"))
    df = df.withColumn("text", text)
    t = F.col("text")
    return df.withColumns(
        {
            "required": required_classes(t),
            "generic_vehicle": generic_vehicle(t),
            "intent": intent(t),
            "has_color": has_color(t),
            "needs_verification": needs_verification(t),
            "object_en": object_en(t),
            "color_en": color_en(t),
        }
    )


def fill_unknown(parsed: DataFrame, extracted: DataFrame) -> DataFrame:
    """Object and colour from a user's extractor (``text, object, color``) where the rules find no object.
    Only gaps are filled, and a colour found by rule stays."""
    e = extracted.select(F.col("text"), F.col("object").alias("__o"), F.col("color").alias("__c"))
    e = e.withColumn("__k", fold(F.col("text"))).drop("text").dropDuplicates(["__k"])
    open_ = F.col("object_en").isNull()
    out = parsed.withColumn("__k", fold(F.col("text"))).join(e, "__k", "left")
    return out.withColumns(
        {
            "color_en": F.when(open_, F.coalesce("color_en", "__c")).otherwise(F.col("color_en")),
            "object_en": F.coalesce("object_en", "__o"),
        }
    ).drop("__k", "__o", "__c")


def unresolved_texts(parsed: DataFrame) -> DataFrame:
    """Distinct texts (one for each folded form) that an extractor should see."""
    return parsed.where("object_en is null").select("text").withColumn("__k", fold(F.col("text"))).dropDuplicates(["__k"]).drop("__k")
