"""Annotation lines of several raters: checks of documents, filters, merges, adjudication and edits.

The working form is one row per line: clip_id, frame_number, rater, kind ('pleura' or 'b'), line_ord (order
inside the frame), the end points x1, y1, x2, y2 and coordinate_space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sonoloom.functions import points as P

#: Fixed values of the document model.
RESERVED = ("__all__", "__adjudicated__")
CLAMP = (2, 10)


#: Kinds of the scalars and lists of a document, the keys that it, a frame and a line need, and the spaces.
KINDS = {
    "SOPInstanceUID": "string", "GrayscaleConversion": "boolean", "mask_type": "string", "angle1": "number", "angle2": "number", "center_rows_px": "integer", "center_cols_px": "integer", "radius1": "integer",
    "radius2": "integer", "image_size_rows": "integer", "image_size_cols": "integer", "AnnotationLabels": "strings", "labels": "strings", "frame_annotations": "array",
}
NEEDED, FRAME_NEEDED, LINE_NEEDED, SPACES = ("SOPInstanceUID", "frame_annotations"), ("frame_number", "pleura_lines", "b_lines"), ("rater", "line"), ("LPS", "RAS")
#: What the schema of a variant is called for each kind.
VARIANTS = {
    "string": "^STRING$", "boolean": "^BOOLEAN$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^(BIGINT$|DECIMAL.[0-9]+,0)", "strings": "^ARRAY<(STRING|VOID)>$",
    "text or integer": "^(STRING$|BIGINT$|DECIMAL.[0-9]+,0)",
}


def _sound() -> str:
    """A pattern that only texts without a fault match: documents as they are written here, without white space and escapes, with one
    key at most that is none of the model's in a document, a frame and a line, so that no key can repeat. Groups are possessive, so they do not nest calls."""
    several = lambda x: rf"\[(?:{x}(?:,{x})*+)?+\]"
    text, integer, number = r'"[^"\\\x00-\x1f]*+"', r"(?:0|-?[1-9][0-9]{0,14}+)", r"-?(?:0|[1-9][0-9]{0,14}+)(?:\.[0-9]{1,15}+)?+(?:E-?[0-9]{1,2}+)?+"
    scalar = f"(?:{text}|{number}|true|false|null)"
    member = lambda value: rf"\{{{text}:{value}\}}"
    more = lambda *known: rf'(?:,"(?!(?:{"|".join(known)})")[A-Za-z0-9_]++":(?:{scalar}|{several(f"(?:{scalar}|{member(scalar)})")}|{member(several(scalar))}))?+'
    validation = rf'(?:,"validation":\{{"status":{text},"adjudicator":{text},"timestamp":{text}\}})?+'
    line = rf'\{{"rater":{text},"line":\{{"points":{several(rf"\[{number},{number},{number}\]")}\}}{validation}{more(*LINE_NEEDED, "validation")}\}}'
    frame = rf'\{{"frame_number":(?:{integer}|{text}),"coordinate_space":"(?:{"|".join(SPACES)})","pleura_lines":{several(line)},"b_lines":{several(line)}{more(*FRAME_NEEDED, "coordinate_space")}\}}'
    return rf'^\{{"SOPInstanceUID":{text}(?:,"radius1":{integer})?+{more(*KINDS)}(?:,"labels":{several(text)})?+,"frame_annotations":{several(frame)}\}}\z'


#: Longer texts are parsed in any case.
SOUND, SOUND_LENGTH = _sound(), 1 << 20


def faults(json: Column) -> Column:
    """array(struct(at, message)) of what is wrong with a JSON document; ``at`` is the place, keys and list numbers joined by slashes.

    A text is parsed once, the members of an object are taken in one go, and places are put together for faults only. Most texts have the
    form of ``SOUND`` and need no parsing.
    """
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - worked out once
    members = lambda v, *names: F.try_variant_get(v, "$", f"struct<{','.join(f'{k}:variant' for k in names)}>")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    fault = lambda wrong, at, message: F.when(wrong, F.concat(at, F.lit(f"\n{message}")))  # noqa: E731 - plain text, which costs less than a struct inside
    odd = lambda v, kind: ~F.schema_of_variant(v).rlike(VARIANTS[kind])
    wrong_kind = lambda v, kind, at: fault(v.isNotNull() & (listed(v).isNull() if kind == "array" else odd(v, kind)), at, f"not of kind {kind}")
    missing = lambda d, names, at: [fault(d[k].isNull(), at, f"{k} is required") for k in names]
    below = lambda at, *more: F.concat(at, *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in more))
    each = lambda v, use: F.flatten(F.transform(F.coalesce(listed(v), F.array().cast("array<variant>")), use))

    def of_point(numbers, spot):
        no_number = F.exists(numbers, lambda x: F.coalesce(odd(x, "number"), F.lit(True)))
        return F.array(fault(numbers.isNull() | (F.size(numbers) != 3), spot, "not 3 items"), fault(no_number, spot, "not of kind number"))

    def of_line(entry, points, place):
        line = entry["line"]
        out = [*missing(entry, LINE_NEEDED, place), wrong_kind(entry["rater"], "string", below(place, "/rater"))]
        out += [fault(line.isNotNull() & members(line, "_").isNull(), below(place, "/line"), "not of kind object"), fault(line.isNotNull() & points.isNull(), below(place, "/line"), "points is required")]
        out += [wrong_kind(points, "array", below(place, "/line/points"))]
        return F.flatten(F.array(F.array(*out), each(points, lambda point, j: bound(listed(point), lambda numbers: of_point(numbers, below(place, "/line/points/", j))))))

    def of_frame(frame, at):
        space = F.try_variant_get(frame["coordinate_space"], "$", "string")
        line = lambda kind: lambda v, i: bound(members(v, *LINE_NEEDED), lambda entry: bound(members(entry["line"], "points"), lambda d: of_line(entry, d["points"], below(at, f"/{kind}/", i))))
        out = [*missing(frame, FRAME_NEEDED, at), wrong_kind(frame["frame_number"], "text or integer", below(at, "/frame_number"))]
        out += [fault(frame["coordinate_space"].isNotNull() & ~F.coalesce(space.isin(*SPACES), F.lit(False)), below(at, "/coordinate_space"), f"not one of {', '.join(SPACES)}")]
        out += [wrong_kind(frame[k], "array", below(at, f"/{k}")) for k in FRAME_NEEDED[1:]]
        return F.flatten(F.array(F.array(*out), *(each(frame[kind], line(kind)) for kind in FRAME_NEEDED[1:])))

    def of_root(root, d):
        frame = lambda v, i: bound(members(v, *FRAME_NEEDED, "coordinate_space"), lambda f: of_frame(f, below(F.lit("frame_annotations/"), i)))
        out = [fault(root.isNull(), F.lit(""), "not readable"), *(F.when(root.isNotNull(), f) for f in missing(d, NEEDED, F.lit("")))]
        out += [wrong_kind(d[k], kind, F.lit(k)) for k, kind in KINDS.items()]
        return F.flatten(F.array(F.array(*out), each(d["frame_annotations"], frame)))

    found = bound(F.try_parse_json(json), lambda root: bound(members(root, *KINDS), lambda d: of_root(root, d)))
    told = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(F.substring_index(x, "\n", 1).alias("at"), F.substring_index(x, "\n", -1).alias("message")))
    return F.when((F.length(json) < SOUND_LENGTH) & json.rlike(SOUND), F.array().cast("array<struct<at:string,message:string>>")).otherwise(told)


def validate_documents(docs: DataFrame) -> DataFrame:
    """(columns of ``docs`` but json, at, message): what is wrong with each JSON document, one row for each fault.

    A text that is no JSON has one fault. ``at`` is the place, keys and list numbers joined by slashes.
    """
    return docs.select(*(c for c in docs.columns if c != "json"), F.inline(faults(F.col("json"))))


def measurements(lines: DataFrame) -> DataFrame:
    """Measurement rows, ready to append: whose, of which instance, when (``at``), length to three decimals, base name of the image."""
    length = F.format_string("%.3f", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return lines.select("PatientName", "PatientID", "DicomInstanceUID", F.date_format("at", "yyyy-MM-dd_HH:mm:ss").alias("Timestamp"), length.alias("Length"), F.substring_index("image", "/", -1).alias("ImageFilename"))


def clean_nested(lines: Column) -> Column:
    return F.filter(F.coalesce(lines, F.array()), lambda x: F.coalesce(F.size(x), F.lit(0)) > 0)


def filter_rater(lines: DataFrame, rater: str) -> DataFrame:
    return lines.where(F.lower(F.trim("rater")) == rater.strip().lower())


def filter_selected(lines: DataFrame, raters: list[str]) -> DataFrame:
    """Lines of the selected raters; of an empty selection none."""
    return lines.where(F.col("rater").isin(*raters)) if raters else lines.where(F.lit(False))


def filter_validated(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("status") == "validated")


def filter_visible(lines: DataFrame, show_invalid: bool = False) -> DataFrame:
    """Lines without the invalidated ones, unless these are asked for; a missing status is visible."""
    return lines if show_invalid else lines.where(F.coalesce("status", F.lit("")) != "invalidated")


def filter_min_points(lines: DataFrame, least: int = 2) -> DataFrame:
    """Lines with ``least`` points whose first two differ."""
    return lines.where((F.size("points") >= least) & (F.get("points", F.lit(0)) != F.get("points", F.lit(1))))


def drop_frame(lines: DataFrame, frame: int) -> DataFrame:
    return lines.where(F.col("frame_number") != frame)


def copy_lines(lines: DataFrame, frame: Column, rater: str) -> DataFrame:
    """The lines put on ``frame`` under ``rater``; ``paste_new`` then leaves out those that are there."""
    return lines.withColumns({"frame_number": frame, "rater": F.lit(rater)})


def reset_validation(lines: DataFrame, frame: int) -> DataFrame:
    """Every line of a frame becomes unadjudicated."""
    return lines.withColumn("status", F.when(F.col("frame_number") == frame, F.lit("unadjudicated")).otherwise(F.col("status")))


def labels_in_vocabulary(labelled: DataFrame, vocabulary: DataFrame, key: str = "clip_id") -> DataFrame:
    """(key, known, unknown): how many of each document's ``labels`` are in the vocabulary's ``label``."""
    words = vocabulary.select("label", F.lit(True).alias("known")).distinct()
    used = labelled.select(key, F.explode("labels").alias("label")).join(words, "label", "left")
    return used.groupBy(key).agg(F.count_if(F.col("known").isNotNull()).alias("known"), F.count_if(F.col("known").isNull()).alias("unknown"))


def frame_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("clip_id", "frame_number").agg(F.count_if(F.col("kind") == "pleura").alias("n_pleura"), F.count_if(F.col("kind") == "b").alias("n_b"))


def max_lines(lines: DataFrame) -> DataFrame:
    """Largest number of lines in a frame for each kind, clamped."""
    low, high = CLAMP
    clamped = lambda c: F.least(F.lit(high), F.greatest(F.lit(low), F.max(c)))
    return frame_counts(lines).groupBy("clip_id").agg(clamped("n_pleura").alias("max_pleura"), clamped("n_b").alias("max_b"))


def distinct_raters(lines: DataFrame, current: str) -> DataFrame:
    """The current rater, the reserved names, then the other raters in order."""
    found = lines.groupBy("clip_id").agg(F.array_sort(F.collect_set(F.lower("rater"))).alias("r"))
    rest = F.array_except("r", F.array(*map(F.lit, (current, *RESERVED))))
    return found.select("clip_id", F.concat(F.array(*map(F.lit, (current, *RESERVED))), rest).alias("raters"), F.size(F.array_except("r", F.array(*map(F.lit, RESERVED)))).alias("n_real"))


def latest_validation(statuses: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("status", "adjudicator", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")), F.struct("ts", "event_id"))
    return statuses.groupBy("line_id").agg(last.alias("v")).select("line_id", "v.*")


def toggled(status: Column) -> Column:
    return F.when(status == "validated", "invalidated").when(status == "invalidated", "unadjudicated").otherwise("validated")


def validate_bulk(lines: DataFrame, adjudicator: str, at: Column, status: str = "validated") -> DataFrame:
    """Every unadjudicated line (a missing status counts) gets ``status``, by ``adjudicator``, at the time ``at``; ``changed`` tells which."""
    open_ = F.coalesce("status", F.lit("unadjudicated")) == "unadjudicated"
    return lines.withColumns({"status": F.when(open_, F.lit(status)).otherwise(F.col("status")), "adjudicator": F.when(open_, F.lit(adjudicator)).otherwise(F.col("adjudicator")), "timestamp": F.when(open_, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.col("timestamp")), "changed": open_})


def replace_lines(lines: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` without those of any key in ``new``, plus ``new``."""
    return lines.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_own(lines: DataFrame, selected: DataFrame, rater: str) -> DataFrame:
    """``lines`` without the selected ones that belong to ``rater``."""
    return lines.join(selected.where(F.col("rater") == rater), lines.columns[: lines.columns.index("x1")], "left_anti")


def paste_new(existing: DataFrame, pasted: DataFrame) -> DataFrame:
    """Pasted lines that equal no existing line of their frame and kind, in either direction."""
    e = existing.select("clip_id", "frame_number", "kind", *(F.col(c).alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")))
    d2 = lambda a, b, c, d: F.pow(F.col(a) - F.col(f"e{c}"), F.lit(2)) + F.pow(F.col(b) - F.col(f"e{d}"), F.lit(2))
    near = lambda a, b, c, d: d2(a, b, c, d) < P.SAME_LINE_SQUARED
    same = (near("x1", "y1", "x1", "y1") & near("x2", "y2", "x2", "y2")) | (near("x1", "y1", "x2", "y2") & near("x2", "y2", "x1", "y1"))
    p, q = pasted.alias("p"), e.alias("q")
    keys = (F.col("p.clip_id") == F.col("q.clip_id")) & (F.col("p.frame_number") == F.col("q.frame_number")) & (F.col("p.kind") == F.col("q.kind"))
    return p.join(q, keys & same, "left_anti")


def nearest_line(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query point of a frame its closest line within picking distance; ties go to the earlier line."""
    met = queries.join(lines, ["clip_id", "frame_number"]).withColumn("d2", P.segment_distance_squared(*map(F.col, ("px", "py", "x1", "y1", "x2", "y2"))))
    best = met.where(F.col("d2") < P.PICK_SQUARED).groupBy("clip_id", "frame_number", "px", "py").agg(F.min(F.struct("d2", "line_ord")).alias("m"))
    return best.select("clip_id", "frame_number", "px", "py", "m.line_ord", "m.d2")


def match_validation(lines: DataFrame, validations: DataFrame) -> DataFrame:
    """The first line (pleura first, then order) of the validation's frame and rater with the same points."""
    v = validations.alias("v")
    same = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        same = same & (F.abs(F.col(f"l.{c}") - F.col(f"v.{c}")) < P.SAME_POINT)
    keys = F.lit(True)
    for c in ("clip_id", "frame_number", "rater"):
        keys = keys & (F.col(f"l.{c}") == F.col(f"v.{c}"))
    met = lines.alias("l").join(v, keys & same)
    rank = F.min(F.struct(F.when(F.col("l.kind") == "pleura", 0).otherwise(1).alias("k"), F.col("l.line_ord").alias("line_ord"))).alias("m")
    return met.groupBy("v.validation_id").agg(rank).select("validation_id", "m.line_ord", F.when(F.col("m.k") == 0, "pleura").otherwise("b").alias("kind"))


def merge_scalars(files: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """First non-empty value of each field in path order."""
    first = lambda c: F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("path")))
    return files.groupBy(key).agg(*(first(c).alias(c) for c in fields))


def merge_conflicts(files: DataFrame, key: str, field: str) -> DataFrame:
    """Files whose non-empty value differs from the one kept."""
    kept = merge_scalars(files, key, [field]).select(key, F.col(field).alias("kept"))
    return files.where(F.coalesce(F.col(field), F.lit("")) != "").join(kept, key).where(F.col(field) != F.col("kept")).select(key, "path", F.col(field).alias("value"), "kept")


def merge_labels(files: DataFrame, key: str) -> DataFrame:
    """Union of list values without repeats, in the order first seen along paths."""
    seen = files.select(key, "path", F.posexplode("labels").alias("pos", "label")).groupBy(key, "label").agg(F.min(F.struct("path", "pos")).alias("at"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))


def toggle_label(labels: Column, label: Column) -> Column:
    return F.when(F.array_contains(labels, label), F.array_remove(labels, label)).otherwise(F.concat(labels, F.array(label)))


def next_unlabeled(catalogue: DataFrame, labelled: DataFrame, cursor: Column) -> DataFrame:
    """Per patient: first index from ``cursor`` on of an instance without labelled frames."""
    at = catalogue.join(labelled.select("InstanceUID", F.lit(True).alias("done")).distinct(), "InstanceUID", "left")
    return at.groupBy("PatientUID").agg(F.min(F.when(F.col("done").isNull() & (F.col("index") >= cursor), F.col("index"))).alias("next"))


def last_line(lines: DataFrame) -> DataFrame:
    """The newest line of each frame, kind and rater: the one that an undo removes."""
    order = W.partitionBy("clip_id", "frame_number", "kind", "rater").orderBy(F.desc("line_ord"))
    return lines.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


