"""From a taxonomy to a table of text requests, and from answers to a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import combinations as C
from spanloom.operators import neighbours as N
from spanloom.operators import requests as R
from spanloom.operators import splits as P
from spanloom.session import cut_lineage

# Settings of a normal run.
NEIGHBOURS = 20
THRESHOLD = 0.83
MAX_SIZE = 5

# How a reference is shown as an example.
SHOT_QUESTION = "skills: "
SHOT_ANSWER = "Job Opening : "


def neighbours(taxonomy: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest of each name without threshold, written: one search for lists and words to avoid."""
    return cut_lineage(N.nearest(taxonomy, k), "near")


def combinations(taxonomy: DataFrame, popularity: DataFrame, n: int, k: int = NEIGHBOURS, threshold: float = THRESHOLD,
                 size_weights=None, seed=42, near: DataFrame | None = None, **options) -> DataFrame:
    """``n`` balanced combinations of a merged taxonomy with vectors, written once for the steps that follow.

    ``near`` is the written result of :func:`neighbours`, so that the same
    search serves the words to avoid.
    """
    weights = size_weights or [1.0 / MAX_SIZE] * MAX_SIZE
    near = N.nearest(taxonomy, k, threshold) if near is None else near.where(F.col("sim") > threshold)
    lists = C.neighbour_lists(near, popularity)
    return cut_lineage(C.combine(C.balanced_numbered_draws(taxonomy, n, seed), lists, weights, seed, **options))


def generation_requests(combos: DataFrame, taxonomy: DataFrame, templates: DataFrame, forced_mode: str | None = None,
                        overrides: dict[str, str] | None = None, near: DataFrame | None = None) -> DataFrame:
    """(request_id, draw_id, mode, members, messages) for each combination and mode.

    ``templates`` has (mode, system, instruction, shots); a mode without one is an error.
    """
    modes = R.route_modes(combos, forced_mode)
    R.require_valid_kinds(modes, templates, ["mode"])
    routed = modes.join(N.neighbours_outside(combos, taxonomy, near=near), "draw_id")
    told = routed.join(R.additional_info(combos, taxonomy), "draw_id", "left").join(templates, "mode")
    values = R.placeholder_values(F.col("members"), F.col("additional"), F.col("avoid"), overrides)
    user = F.concat(F.lit("skills: "), R.list_text(F.col("members")))
    chat = R.build_messages(
        R.fill_template(F.col("system"), values), R.fill_template(F.col("instruction"), values), F.col("shots"), user)
    return told.select(
        F.concat_ws("-", "draw_id", "mode").alias("request_id"), "draw_id", "mode", "members", chat.alias("messages"))


def reference_shots(found: DataFrame, references: DataFrame, text: str = "skill_sentence", reference: str = "reference_id") -> DataFrame:
    """(draw_id, shots) for :func:`generation_requests`: the chosen references, best first, as question and answer.

    ``found`` comes from :func:`nearest_references`; a reference text is ``skill : sentence``.
    """
    halves = F.split(F.col(text), " : ", -1)
    shot = F.struct(F.concat(F.lit(SHOT_QUESTION), halves[0]).alias("question"),
                    F.concat(F.lit(SHOT_ANSWER), F.coalesce(F.get(halves, F.lit(1)), F.lit("")), F.lit(".")).alias("answer"))
    listed = F.array_sort(F.collect_list(F.struct("rank", shot.alias("shot"))))
    return found.join(references.select(reference, text), reference).groupBy("draw_id").agg(listed.alias("s")).select(
        "draw_id", F.transform("s", lambda e: e["shot"]).alias("shots"))


def collect_samples(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, skills, sentence, mode); a lost answer gives a null sentence."""
    joined = R.attach_answers(requests.select("request_id", "members", "mode"), answers)
    return joined.select("request_id", F.col("members").alias("skills"), F.col("answer").alias("sentence"), "mode")


def with_negatives(splits: DataFrame, negatives: DataFrame, excluded: DataFrame | None = None, seed=42) -> DataFrame:
    """Split samples with split negatives (and relabelled samples of excluded entities) mixed in.

    ``splits`` has (sentence, skills, split); the others have (sentence, skills).
    A sentence that would land in two splits is an error. All tables are put in
    random order together, once.
    """
    parts = splits.select("sentence", "skills", "split")
    more = None
    for table in [negatives] if excluded is None else [negatives, P.relabel(excluded)]:
        known = table.where(F.col("sentence").isNotNull()).select("sentence", "skills")
        placed = P.assign_splits(known, "sentence", P.rest_sizes(P.distinct_count(known, "sentence")), seed)
        more = placed if more is None else more.unionByName(placed)
    P.require_disjoint(parts.unionByName(more), "sentence")
    return P.merge_samples(parts, more, seed)
