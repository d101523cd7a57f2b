"""Annotation documents as files hold them, read to one row per line and written back.

A document is an object with an instance UID, any scalars and lists, and ``frame_annotations``: a list of
``{frame_number, coordinate_space, pleura_lines, b_lines}``, whose lines are ``{rater, line: {points}, validation}``. The older
form has an object of frames by number there, with bare point lists and the rater in the path only.

Documents are parsed to VARIANT once. Keys that are not known stay: those of a document in ``head``, those of
a line in ``extra``, both JSON objects. A file with a fault gives one row of ``errors`` and no line.

The working form of a line: the keys of the document's row, place of the frame (``frame_at``), ``frame_number`` (an int where it
is one), ``frame_key`` (as given), kind ('pleura' or 'b'), line_ord (place in its list), rater, points in the wanted space, the ends x1, y1, x2, y2,
``validation`` (status, adjudicator, timestamp; null: nobody judged) and ``extra``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sonoloom.functions import points as P

#: Fixed values of the document model.
FRAMES, KINDS, DEFAULT_SPACE = "frame_annotations", {"pleura": "pleura_lines", "b": "b_lines"}, "RAS"
VALIDATION = "struct<status:string,adjudicator:string,timestamp:string>"


class Documents(NamedTuple):
    """``heads``: a row per sound document with its instance UID, labels and ``head``; ``lines``; ``errors``: a message per faulty one."""

    heads: DataFrame
    lines: DataFrame
    errors: DataFrame


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _but(v: Column, *known: str) -> Column:
    """JSON object of the keys of a variant object that are not ``known``."""
    return F.to_json(F.map_filter(F.coalesce(_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*known)))


def spliced(first: Column, second: Column) -> Column:
    """One JSON object with the members of two, neither of which repeats a key of the other."""
    whole = lambda a, b: F.when(a == "{}", b).when(b == "{}", a).otherwise(F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit(","), F.substring(b, F.lit(2), F.length(b))))
    return F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), lambda x: whole(x["a"], x["b"]))[0]  # each is made once


def as_text(v: Column) -> Column:
    """A variant scalar as text: strings bare, numbers as JSON writes them."""
    return F.coalesce(_get(v, "$", "string"), F.to_json(v))


def _point_faults(entries: Column) -> Column:
    """Whether a line has no list of ``points`` with two numbers at least."""
    return F.exists(entries, lambda e: e["points"].isNull() | F.exists(e["points"], lambda p: (F.size(p) < 2) | F.exists(F.slice(p, 1, 2), lambda x: x.isNull())))


def read_documents(docs: DataFrame, space: str = "RAS") -> Documents:
    """Parse ``docs`` (any columns besides ``json``); points come back in ``space``, x and y turned where the frame says otherwise.

    A fault is a text that is no JSON object, no list of frames, a frame that is no object or has no number, or a line without points. A missing rater is null, a missing line list is empty.
    Heads, lines and errors are each made by one generator, which parses a text once and which no later filter repeats.
    """
    keys = [c for c in docs.columns if c != "json"]
    entry = lambda e: F.struct(e.alias("e"), _get(e, "$.line.points", "array<array<double>>").alias("points"))
    lists = lambda f: F.array(*(F.struct(F.lit(k).alias("kind"), F.transform(F.coalesce(_get(f, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), entry).alias("entries")) for k, name in KINDS.items()))
    frame = lambda f: F.struct(as_text(_get(f, "$.frame_number", "variant")).alias("key"), F.coalesce(_get(f, "$.coordinate_space", "string"), F.lit(DEFAULT_SPACE)).alias("space"), lists(f).alias("lists"))
    is_object = lambda v: _get(v, "$", "struct<_:variant>").isNotNull()
    message = lambda d: (
        F.when(~is_object(d["v"]), "not a JSON object").when(d["f"].isNull(), "no list of frames")
        .when(F.exists(d["f"], lambda f: f["key"].isNull()), "a frame without number").when(F.exists(d["f"], lambda f: F.exists(f["lists"], lambda x: _point_faults(x["entries"]))), "a line without points")
    )
    opened = F.transform(F.array(F.try_parse_json("json")), lambda v: F.struct(v.alias("v"), F.transform(_get(v, f"$.{FRAMES}", "array<variant>"), frame).alias("f")))
    sound = F.filter(opened, lambda d: message(d).isNull())

    head = lambda d: F.struct(_get(d["v"], "$.SOPInstanceUID", "string").alias("SOPInstanceUID"), F.coalesce(_get(d["v"], "$.labels", "array<string>"), F.array().cast("array<string>")).alias("labels"), _but(d["v"], FRAMES, "labels").alias("head"))
    line = lambda f, at, kind: lambda x, i: F.struct(
        at.alias("frame_at"), f["key"].try_cast("int").alias("frame_number"), f["key"].alias("frame_key"), kind.alias("kind"), i.alias("line_ord"), _get(x["e"], "$.rater", "string").alias("rater"),
        P.ras_lps(x["points"], f["space"], space).alias("points"), _get(x["e"], "$.validation", VALIDATION).alias("validation"), _but(x["e"], "rater", "line", "validation").alias("extra"),
    )
    of_frame = lambda f, at: F.flatten(F.transform(f["lists"], lambda x: F.transform(x["entries"], line(f, at, x["kind"]))))
    of_document = F.flatten(F.transform(sound, lambda d: F.flatten(F.transform(d["f"], of_frame))))
    errors = F.filter(F.transform(opened, lambda d: F.struct(message(d).alias("message"))), lambda x: x["message"].isNotNull())
    return Documents(docs.select(*keys, F.inline(F.transform(sound, head))), with_ends(docs.select(*keys, F.inline(of_document))), docs.select(*keys, F.inline(errors)))


def with_ends(lines: DataFrame) -> DataFrame:
    """``lines`` with the coordinates of the first two points."""
    at = lambda i, j: F.get(F.get("points", F.lit(i)), F.lit(j))
    return lines.withColumns({"x1": at(0, 0), "y1": at(0, 1), "x2": at(1, 0), "y2": at(1, 1)})


def _with_fields(lines: DataFrame) -> DataFrame:
    """Missing fields of the working form: ``points`` from the ends, no validation, no extra, the number as key."""
    have = set(lines.columns)
    missing = {
        "points": lambda: F.array(F.array("x1", "y1", F.lit(0.0)), F.array("x2", "y2", F.lit(0.0))), "validation": lambda: F.lit(None).cast(VALIDATION),
        "extra": lambda: F.lit("{}"), "frame_key": lambda: F.col("frame_number").cast("string"),
    }
    return lines.withColumns({c: make() for c, make in missing.items() if c not in have})


def write_documents(lines: DataFrame, keys: list[str], heads: DataFrame | None = None, space: str = "LPS", keep_empty: bool = False) -> DataFrame:
    """(keys, json): one document for each value of ``keys``, its frames by number and its lines in order, points turned from RAS to ``space``.

    ``heads`` has ``keys``, ``head`` and ``labels``; with ``keep_empty`` its documents without any line are written too, with no frames, as after
    the last line was deleted. Without ``heads`` the instance UID is the first key's text.
    """
    full = _with_fields(lines.repartition(*keys))
    number, digits = F.col("frame_key").try_cast("int"), F.col("frame_key").rlike("^[0-9]+$")
    entry = F.to_json(F.struct(F.coalesce("rater", F.lit("")).alias("rater"), F.struct(P.ras_lps(F.col("points"), F.lit("RAS"), space).alias("points")).alias("line"), "validation"))
    held = full.select(*keys, "frame_key", number.alias("at"), F.struct(F.col("line_ord").cast("long").alias("line_ord"), spliced(entry, F.coalesce("extra", F.lit("{}"))).alias("e"), F.col("kind").alias("kind")).alias("l"))
    frame = held.groupBy(*keys, "at", "frame_key").agg(F.array_sort(F.collect_list("l")).alias("l"))
    listed = lambda kind: F.concat(F.lit("["), F.array_join(F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["e"]), ","), F.lit("]"))
    shown = F.when(digits, number.cast("string")).otherwise(F.to_json(F.array("frame_key")).substr(F.lit(2), F.length(F.to_json(F.array("frame_key"))) - 2))
    body = F.concat(F.lit('{"frame_number":'), shown, F.lit(f',"coordinate_space":"{space}"'), *(x for k, name in KINDS.items() for x in (F.lit(f',"{name}":'), listed(k))), F.lit("}"))
    doc = frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "frame_key", body.alias("b")))).alias("f"))
    frames = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("f", lambda x: x["b"]), ","), F.lit("")), F.lit("]"))
    if heads is None:
        whole, head, labels = doc, F.to_json(F.struct(F.col(keys[0]).cast("string").alias("SOPInstanceUID"))), F.lit("[]")
    else:
        whole = doc.join(heads.select(*keys, "head", "labels"), keys, "right" if keep_empty else "left")
        head, labels = F.coalesce("head", F.lit("{}")), F.coalesce(F.to_json("labels"), F.lit("[]"))
    return whole.select(*keys, spliced(head, F.concat(F.lit('{"labels":'), labels, F.lit(f',"{FRAMES}":'), frames, F.lit("}"))).alias("json"))


def write_adjudication(lines: DataFrame, key: str, heads: DataFrame | None = None) -> DataFrame:
    """(key, file, json): the lines of all raters with their validations in one document of each clip."""
    return write_documents(lines, [key], heads).select(key, F.concat(F.col(key).cast("string"), F.lit(".adjudication.json")).alias("file"), "json")


def write_rater(lines: DataFrame, key: str, rater: str, heads: DataFrame | None = None, changed: bool = False) -> DataFrame:
    """(key, file, json): the lines of one rater, told by trimmed lower case; with ``changed``, clips without any are written too."""
    name = rater.strip().lower()
    own = lines.where(F.lower(F.trim("rater")) == name)
    return write_documents(own, [key], heads, keep_empty=changed).select(key, F.concat(F.col(key).cast("string"), F.lit(f".{name}.json")).alias("file"), "json")


def _legacy_root() -> Column:
    """array(struct(v, by_key)) of one: the root of a document (path, json) of the older form and its object of frames; each is made once."""
    return F.transform(F.array(F.try_parse_json("json")), lambda v: F.struct(v.alias("v"), _get(v, f"$.{FRAMES}", "map<string,variant>").alias("by_key")))


def _legacy_message(d: Column) -> Column:
    """The fault of a root, null where there is none."""
    return F.when(d["v"].isNull(), "not a JSON object").when(F.exists(F.map_keys(d["by_key"]), lambda k: k.try_cast("int").isNull()), "a frame key that is no number")


def _legacy_sorted(d: Column, extra: bool = False) -> Column:
    """The frames of a root by number, with lines and, with ``extra``, their other keys."""
    listed = lambda v, path: _get(v, path, "array<array<array<double>>>")
    # what is nested counts wherever it is there, also where it is no list; asked for as lists, no part of the text is made a variant of its own
    lift = lambda v, name: F.coalesce(listed(v, f"$.annotation.{name}"), F.when(_get(v, f"$.annotation.{name}", "variant").isNull(), listed(v, f"$.{name}")), F.array().cast("array<array<array<double>>>"))
    lines = lambda v, name: F.filter(lift(v, name), lambda x: F.coalesce(F.size(x), F.lit(0)) > 0)
    others = lambda v: spliced(_but(v, "annotation", *KINDS.values(), "frame_number", "coordinate_space"), _but(_get(v, "$.annotation", "variant"), *KINDS.values(), "frame_number", "coordinate_space"))
    frame = lambda x: F.struct(x["key"].try_cast("int").alias("at"), x["key"].alias("frame_key"), *(lines(x["value"], name).alias(k) for k, name in KINDS.items()), *([others(x["value"]).alias("extra")] if extra else []))
    return F.array_sort(F.transform(F.map_entries(d["by_key"]), frame))


def _legacy_frames(docs: DataFrame, lined: bool = True) -> DataFrame:
    """``docs`` of the older form with their root ``v``, the object of frames ``by_key`` and a ``message`` for each fault; where asked for, ``f``, the
    frames. One generator makes them, so a text is parsed once and no later filter repeats it."""
    f = lambda d: [_legacy_sorted(d).alias("f")] if lined else []
    return docs.select("*", F.inline(F.transform(_legacy_root(), lambda d: F.struct(d["v"].alias("v"), d["by_key"].alias("by_key"), _legacy_message(d).alias("message"), *f(d)))))


def rater_of(path: Column) -> Column:
    """Grandparent folder of a file, in lower case."""
    return F.lower(F.regexp_extract(path, "([^/]+)/[^/]+/[^/]+$", 1))


def read_legacy(docs: DataFrame) -> Documents:
    """Lines of documents (path, json) of the older form in RAS, as the older form has them; heads and errors as in ``read_documents``.

    Frames come by number and lines in document order. ``frame_number`` is an int where the key has digits only; ``frame_key`` is the key as
    given. A nested ``annotation`` counts as part of its frame. Empty lines are dropped. A file of the newer form has no lines here.
    """
    keys = [c for c in docs.columns if c != "json"]
    bare = _legacy_frames(docs, lined=False)
    whole = bare.where("message IS NULL")
    heads = whole.select(*keys, _get(F.col("v"), "$.SOPInstanceUID", "string").alias("SOPInstanceUID"), _get(F.col("v"), "$.labels", "array<string>").alias("labels"), _but(F.col("v"), FRAMES, "labels").alias("head"))
    each = _legacy_frames(docs).where("message IS NULL").select(*keys, F.posexplode("f").alias("frame_at", "f"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"f.{k}").alias("entries")) for k in KINDS))
    lines = each.select(*keys, "frame_at", F.col("f.frame_key").alias("frame_key"), F.inline(kinds)).select(*keys, "frame_at", "frame_key", "kind", F.posexplode("entries").alias("line_ord", "points"))
    number = F.when(F.col("frame_key").rlike("^[0-9]+$"), F.col("frame_key").try_cast("int"))
    named = lines.select(*keys, "frame_at", number.alias("frame_number"), "frame_key", "kind", "line_ord", rater_of(F.col("path")).alias("rater"), "points")
    return Documents(heads, with_ends(named), bare.where("message IS NOT NULL").select(*keys, "message"))


def convert_legacy(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, file, json), errors): documents (path, json) of the older form as newer ones, points in LPS, the rater on each line.

    A document of the newer form passes unchanged. Frames keep their other keys, and frames without lines stay.
    """
    turned = lambda points: P.ras_lps(points, F.lit("RAS"), "LPS")
    entries = lambda f, kind, rater: F.to_json(F.transform(f[kind], lambda line: F.struct(rater.alias("rater"), F.struct(turned(line).alias("points")).alias("line"))))
    key = lambda f: F.when(f["frame_key"].rlike("^[0-9]+$"), f["at"].cast("string")).otherwise(F.concat(F.lit('"'), f["frame_key"], F.lit('"')))
    frame = lambda f, rater: spliced(F.concat(F.lit('{"frame_number":'), key(f), F.lit(',"coordinate_space":"LPS"'), *(x for k, name in KINDS.items() for x in (F.lit(f',"{name}":'), entries(f, k, rater))), F.lit("}")), f["extra"])
    frames = lambda d, rater: F.concat(F.lit(f'{{"{FRAMES}":['), F.array_join(F.transform(_legacy_sorted(d, extra=True), lambda f: frame(f, rater)), ","), F.lit("]}"))
    newer = lambda d, rater: F.when(d["by_key"].isNull(), F.col("json")).otherwise(spliced(_but(d["v"], FRAMES), frames(d, rater)))
    name = F.regexp_replace(F.substring_index("path", "/", -1), "\\.[^.]*$", "")
    file = lambda rater: F.concat(F.regexp_extract("path", "^(.*/)?", 0), name, F.lit("."), rater, F.lit(".json"))
    # a sound document goes from its text to its text in one generator, so that no frame becomes a row's column on the way
    made = lambda d: F.transform(F.array(rater_of(F.col("path"))), lambda rater: F.struct(file(rater).alias("file"), newer(d, rater).alias("json")))[0]
    done = docs.select("path", F.inline(F.transform(F.filter(_legacy_root(), lambda d: _legacy_message(d).isNull()), made)))
    return done, _legacy_frames(docs, lined=False).where("message IS NOT NULL").select("path", "message")
