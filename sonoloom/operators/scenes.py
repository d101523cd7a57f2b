"""Clean-up of scenes: nodes by class, their references, and what a scene has chosen.

``nodes`` has scene, node, class, name; ``refs`` has scene, source, target; ``chosen`` has scene, browser, atlas, landmark, patient, scan, one row
for each scene, null where nothing is chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: The classes that clean-up looks at, and the name that saves a region of interest.
SEQUENCE, BROWSER, MODEL, FIDUCIAL, CURVE, ROI, SAVED_NAME = "Sequence", "SequenceBrowser", "Model", "MarkupsFiducial", "MarkupsCurve", "MarkupsROI", "Reconstructor"
UNKNOWN_BROWSER = "no sequence browser is chosen"


def prune_orphans(nodes: DataFrame, refs: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((scene, node, class, name, why), errors): the nodes that stay, some under a new name, and scenes without a chosen browser, which are left as an error.

    Of sequences those stay that the chosen browser refers to; of browsers the chosen one; of models and fiducials the chosen
    atlas and landmark, or all of the class where none is chosen; no curve; of regions those with the saving name; of other classes all.
    The chosen atlas and landmark are named after patient and scan. References from other scenes do not count.
    """
    errors = chosen.where("browser IS NULL").select("scene", F.lit(UNKNOWN_BROWSER).alias("error"))
    pick = chosen.where("browser IS NOT NULL")
    held = refs.join(pick.select("scene", F.col("browser").alias("source")), ["scene", "source"], "left_semi").select("scene", F.col("target").alias("node"))
    is_a = lambda c: F.col("class").eqNullSafe(F.lit(c))
    never = is_a(CURVE) | (is_a(ROI) & ~F.coalesce(F.contains("name", F.lit(SAVED_NAME)), F.lit(False)))
    sequences = nodes.where(is_a(SEQUENCE)).join(held, ["scene", "node"], "left_semi").select("scene", "node", "class", "name", F.lit("referenced").alias("why"))
    seen = nodes.where(~is_a(SEQUENCE) & ~never).join(pick, "scene")  # a node is shuffled once, by its scene or, a sequence, by its name too
    own = lambda c: F.coalesce(F.col("node") == F.col(c), F.lit(False))
    of = F.col("class")
    why = (
        F.when(of == BROWSER, F.when(own("browser"), "chosen"))
        .when(of == MODEL, F.when(F.col("atlas").isNull(), "none chosen").when(own("atlas"), "chosen")).when(of == FIDUCIAL, F.when(F.col("landmark").isNull(), "none chosen").when(own("landmark"), "chosen"))
        .when(of == ROI, "named").otherwise("other")
    )
    prefix = F.concat(F.coalesce("patient", F.lit("None")), F.lit("_"), F.coalesce("scan", F.lit("None")), F.lit("_"))
    name = F.when((of == MODEL) & own("atlas"), F.concat(prefix, F.lit("AtlasModel"))).when((of == FIDUCIAL) & own("landmark"), F.concat(prefix, F.lit("Landmarks"))).otherwise(F.col("name"))
    return seen.select("scene", "node", "class", name.alias("name"), why.alias("why")).where("why IS NOT NULL").unionByName(sequences), errors
