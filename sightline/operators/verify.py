"""Verification of hits by yes/no answers: worklist, questions, verdicts and their fusion.

Answers come from a user's model (``answers``: ``query_id, id, kind, answer``; kind is ``presence`` or
``color``; a null answer failed).  A null verdict is not a "no": such a hit keeps its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.params import DEFAULT, Params

# Fixed values. Objects without an article, objects that wear their colour, and the class of an object.
UNCOUNTABLE = ("rain", "snow", "traffic", "fog", "smoke")
PERSONS = ("person", "man", "woman", "child", "pedestrian", "driver", "baby")
CLASS_OF_OBJECT = (
    ("person", "insan"), ("man", "insan"), ("woman", "insan"), ("child", "insan"), ("pedestrian", "insan"),
    ("driver", "insan"), ("baby", "insan"), ("car", "araba"), ("SUV", "araba"), ("truck", "kamyon"),
    ("pickup truck", "kamyon"), ("bus", "otobüs"), ("minibus", "otobüs"), ("motorcycle", "motosiklet"),
    ("bicycle", "bisiklet"),
)


def worklist(hits: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Hits to verify: the first ones of the combined variant, where the query needs it."""
    return hits.where((F.col("variant") == "all") & F.col("needs_verification") & (F.col("rank") <= p.verify_top_n))


def _class_of(obj: Column) -> Column:
    return F.coalesce(*[F.when(obj == o, c) for o, c in CLASS_OF_OBJECT])


def questions(work: DataFrame) -> DataFrame:
    """Adds ``presence_question`` (null where the detector has settled it), ``color_question`` (null
    without a colour) and ``view`` (``crop`` if a colour is asked, else the whole ``frame``)."""
    obj = F.coalesce("object_en", F.lit("object"))
    colored = F.col("color_en").isNotNull()
    named = F.when(obj.isin(*UNCOUNTABLE), obj).otherwise(
        F.concat(F.when(F.lower(F.substring(obj, 1, 1)).isin(*"aeiou"), "an ").otherwise("a "), obj)
    )
    plain = F.when(obj.isin(*UNCOUNTABLE), F.concat(F.lit("Is there "), named, F.lit(" visible in this image?"))).otherwise(
        F.concat(F.lit("Is there "), named, F.lit(" in this image?"))
    )
    whole = F.concat(F.lit("Is there "), named, F.lit(" visible anywhere in this image?"))
    color = F.when(obj.isin(*PERSONS), F.concat(F.lit("Is this "), obj, F.lit(" wearing "), F.col("color_en"), F.lit(" clothing?"))).otherwise(
        F.concat(F.lit("Is the "), obj, F.lit(" "), F.col("color_en"), F.lit(" in color?"))
    )
    settled = colored & (F.col("source") == "crop") & _class_of(obj).eqNullSafe(F.col("yolo_class")) & F.col("yolo_class").isNotNull()
    return work.withColumns(
        {
            "settled": settled,
            "presence_question": F.when(~settled, F.when(colored, plain).otherwise(whole)),
            "color_question": F.when(colored, color),
            "view": F.when(colored, "crop").otherwise("frame"),
        }
    )


_ANSWERS = "query_id string, id string, kind string, answer string"


def ask(asked: DataFrame, make: Callable[[], Callable], crop: str = "crop", frame: str = "frame", tries: int = 2) -> DataFrame:
    """Answers of a user's model to the questions of ``questions``: ``query_id, id, kind, answer``.

    ``make`` is called once in each Python worker and gives ``answer_yes_no(image, question) -> str``;
    the image is the value of the column ``crop`` or ``frame``, by ``view``.  The colour is asked only where
    presence is settled or was answered with yes.  An error is tried again, ``tries`` times in all, and
    is a null answer then; so is a missing image.
    """

    def run(it: Iterator[pa.RecordBatch]):
        model = make()

        def once(image, question):
            for _ in range(tries if image is not None else 0):
                try:
                    return model(image, question)
                except Exception:  # noqa: BLE001  (whatever the user's model raises)
                    continue
            return None

        for b in it:
            rows = []
            for q, i, settled, presence, color, image in zip(*(c.to_pylist() for c in b.columns)):
                there = None
                if presence is not None:
                    there = once(image, presence)
                    rows.append((q, i, "presence", there))
                if color is not None and (settled or (there or "").strip().lower().startswith("y")):
                    rows.append((q, i, "color", once(image, color)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[x.split()[0] for x in _ANSWERS.split(", ")])

    image = F.when(F.col("view") == "crop", F.col(crop)).otherwise(F.col(frame))
    return asked.select("query_id", "id", "settled", "presence_question", "color_question", image.alias("image")).mapInArrow(run, _ANSWERS)


def yes(answer: Column) -> Column:
    """True if the answer begins with a y; null stays null."""
    return F.lower(F.trim(answer)).startswith("y")


def verdicts(work: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds ``verdict`` (``object_present, color_match, confidence``), null where presence is unknown."""
    a = answers.groupBy("query_id", "id").agg(
        F.max(F.when(F.col("kind") == "presence", F.col("answer"))).alias("__p"),
        F.max(F.when(F.col("kind") == "color", F.col("answer"))).alias("__c"),
    )
    # hits are many times their compressed files, by which Spark would broadcast them
    asked = questions(work).join(a.hint("merge"), ["query_id", "id"], "left")
    present = F.when(F.col("settled"), True).otherwise(yes(F.col("__p")))
    match = F.when(F.col("color_question").isNotNull() & present, yes(F.col("__c")))
    verdict = F.when(
        present.isNotNull(),
        F.struct(present.alias("object_present"), match.alias("color_match"), F.when(present, 1.0).otherwise(0.0).alias("confidence")),
    )
    return asked.withColumn("verdict", verdict).drop("__p", "__c")


def fuse(checked: DataFrame, service_up: Column | bool = True, p: Params = DEFAULT) -> DataFrame:
    """Adds ``status`` (``kept`` or ``filtered``), ``unavailable`` and ``vrank`` (of the kept).

    A hit goes if its object is absent, or if a colour was asked for and denied.  The kept are ranked by
    their standardised score plus a bonus for a good verdict.  Where all verdicts of a query are null
    and the service is down, nothing was verified: every hit stays in its old order.
    """
    per_query = W.partitionBy("query_id")
    up = F.lit(service_up) if isinstance(service_up, bool) else service_up
    out = checked.withColumn("unavailable", F.bool_and(F.col("verdict").isNull()).over(per_query) & ~up)
    asked = F.col("has_color")
    conf, match = F.col("verdict.confidence"), F.col("verdict.color_match")
    gone = F.coalesce(conf < p.drop_below, F.lit(False)) | (asked & match.eqNullSafe(F.lit(False)))
    out = out.withColumn("status", F.when(~F.col("unavailable") & gone, "filtered").otherwise("kept"))
    group = W.partitionBy("query_id", "status")
    dev = F.stddev_pop("score").over(group)
    signal = F.when(asked, F.when(F.coalesce(match, F.lit(False)), 1.0).otherwise(0.0)).otherwise(1.0)
    bonus = F.when(F.col("verdict").isNull(), 0.0).otherwise(p.verify_weight * conf * signal)
    z = (F.col("score") - F.avg("score").over(group)) / F.when(dev == 0, 1e-9).otherwise(dev)
    return out.withColumn("vrank", F.when((F.col("status") == "kept") & ~F.col("unavailable"), z + bonus))


def not_found(fused: DataFrame) -> DataFrame:
    """Per query: ``kept``, ``filtered`` and ``reason`` (``color`` or ``object``) where nothing was kept."""
    return (
        fused.groupBy("query_id")
        .agg(
            F.count_if(F.col("status") == "kept").alias("kept"),
            F.count_if(F.col("status") == "filtered").alias("filtered"),
            F.bool_or("has_color").alias("colored"),
        )
        .select("query_id", "kept", "filtered", F.when(F.col("kept") == 0, F.when(F.col("colored"), "color").otherwise("object")).alias("reason"))
    )


def verdict_label(verdict: str = "verdict", has_color: str = "has_color", verified: Column | bool = True) -> Column:
    """What a hit's card says of its verification."""
    v = F.col(verdict)
    color = v["color_match"]
    return (
        F.when(~(F.lit(verified) if isinstance(verified, bool) else verified), "unverified")
        .when(v.isNull(), "failed")
        .when(v["object_present"] & F.col(has_color) & color.eqNullSafe(F.lit(True)), "color ok")
        .when(v["object_present"] & F.col(has_color) & color.eqNullSafe(F.lit(False)), "color wrong")
        .when(v["object_present"], "present")
        .otherwise("no match")
    )


def outcomes(queries: DataFrame, hits: DataFrame, fused: DataFrame | None = None) -> DataFrame:
    """One row for each query: ``n_hits``, ``not_found_reason`` (missing classes, no vehicle, or what
    verification denied), ``time_dropped``, ``applied`` and ``unavailable``.

    ``queries`` carry the gate's columns; ``hits`` are the thinned ones of the combined variant.
    """
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.bool_or("time_dropped").alias("time_dropped"))
    out = queries.select("query_id", "gated", "missing", "no_vehicle").join(per, "query_id", "left")
    if fused is not None:
        state = fused.groupBy("query_id").agg(F.bool_or("unavailable").alias("unavailable"))
        out = out.join(not_found(fused), "query_id", "left").join(state, "query_id", "left")
    else:
        out = out.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("kept", "long"), ("filtered", "long"), ("reason", "string"), ("unavailable", "boolean"))])
    down = F.coalesce("unavailable", F.lit(False))
    shown = F.when(F.col("gated"), 0).when(F.col("kept").isNotNull() & ~down, F.col("kept")).otherwise(F.coalesce("found", F.lit(0)))
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
        .when(F.col("no_vehicle"), "no vehicle")
        .when(~down & F.col("reason").isNotNull(), F.concat(F.lit("denied: "), F.col("reason")))
    )
    return out.select(
        "query_id",
        shown.cast("long").alias("n_hits"),
        reason.alias("not_found_reason"),
        F.coalesce("time_dropped", F.lit(False)).alias("time_dropped"),
        (F.col("kept").isNotNull() & ~down).alias("applied"),
        down.alias("unavailable"),
    )
