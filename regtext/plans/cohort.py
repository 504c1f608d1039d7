"""The cohort build (notes -> labelled, cleaned, split table) composed from the operators.

Every switch of the original dataset constructor has its counterpart: note types routed from several
sources, concatenated lines or the first line only, labels from a registry (J1), from a comorbidity
table (J2) or from a raw registry whose categories become one-hot labels (J3, A8, A9), section filters,
cleaning, and a random (R1) or site/version split (J4, R2) with an optional export of the parts.
The cohort is written once before it is split, since a split reads it several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import cleaning as C
from ..operators import prep as P
from ..operators import split as R
from ..session import materialize
from ..sources import notes as SRC
from ..sources import sinks as SINK


def build_cohort(notes: DataFrame | dict[str, SRC.NoteSource], registry: DataFrame, note_key: str, desc_col: str,
                 line_col: str, text_col: str, registry_keys: dict[str, str], labels: list[str],
                 descriptions: list[str] | None = None, note_types: list[str] | None = None,
                 surgery: list[str] | None = None, concatenate: bool = True, first_line: int = 1,
                 label_source: str = "registry", drop_prefixes: list[str] | None = None, rare_cut: float = K.RARE_CUT,
                 sectionize: list[str] | None = None, preprocess: bool = True, split: str | None = "random",
                 validate: bool = True, versions: DataFrame | None = None, site=None, test_version=None,
                 export: str | None = None) -> DataFrame:
    """-> (note_key, desc, join keys..., labels..., text, split).

    ``registry_keys`` maps note columns to registry columns. Its note columns and ``surgery`` (the columns
    that name one surgery; default: the join keys) go through the concatenation as grouping keys.
    A note that matches several registry rows gives one row, the one with the lowest key values and
    then the lowest label values. With ``concatenate=False`` only ``first_line`` is used, one row per surgery.

    ``label_source``: ``registry`` takes the missing ``labels`` (J1), ``comorbidity`` joins the table without
    its ``drop_prefixes`` columns (J2), ``raw`` keeps one row per surgery and turns the text ``labels`` into
    one-hot columns, values rarer than ``rare_cut`` masked (J3, A8, A9).
    ``split``: ``random``, ``version`` (needs ``versions(join keys..., site, version)`` as the columns
    ``site`` and ``version``, the ``site`` and the ``test_version``) or None.
    """
    if isinstance(notes, dict):                                                              # S2
        notes = SRC.route_sources(notes, note_types or list(notes))
    join_keys = list(registry_keys)
    surgery = list(surgery or join_keys)
    own = [note_key, desc_col]
    keys = own + [c for c in [*join_keys, *surgery] if c not in own]
    keys = list(dict.fromkeys(keys))
    n = SRC.scan_notes(notes, desc_col, descriptions, text_col)                              # S1
    if concatenate:                                                                          # A2
        n = P.ordered_concat(n, keys, line_col, text_col, out_col="text")
    else:                                                                                    # P8, one row per surgery
        n = P.first_line(n.select(*keys, line_col, text_col), line_col, first_line, surgery, [line_col, *own])
        n = n.select(*keys, F.col(text_col).alias("text"))

    reg = registry.select(*[F.col(r).alias(k) for k, r in registry_keys.items()],
                          *[c for c in registry.columns if c not in registry_keys.values() and c not in registry_keys])
    if label_source == "registry":                                                           # J1
        j = P.join_registry(n, reg, join_keys, labels)
        j = P.keyed_dedup(j, own if concatenate else surgery, join_keys)                     # A1
    elif label_source == "comorbidity":                                                      # J2
        j = P.join_dropping(n, reg, join_keys, drop_right_prefixes=drop_prefixes)
        j = P.keyed_dedup(j, own if concatenate else surgery, join_keys)
    elif label_source == "raw":                                                              # J3, A8, A9
        j = P.join_then_dedup(n, reg.select(*join_keys, *labels), join_keys, surgery, own)
        j = materialize(j, "cohort-raw")  # the frequent values are read off it before it is used
        kept = P.frequent_values(j, labels, rare_cut)  # at most 1/rare_cut columns a label, and one for the rest
        masked = P.mask_rare(j, labels, rare_cut, keep=kept)
        rest = masked.agg(*[F.max(F.col(c) == "NULL").alias(c) for c in labels]).first()
        j, labels = P.one_hot(masked, labels, values={c: kept[c] + ["NULL"] * bool(rest[c] and "NULL" not in kept[c]) for c in labels}, drop_source=True)
    else:
        raise ValueError(label_source)
    j = P.labels_to_int(j, labels)                                                           # P6
    steps = [{"medical history": "history", "procedure": "procedure"}[s] for s in sectionize or []]  # T12 / T13
    j = C.clean(j, steps + (["nondiagnostic"] if preprocess else []))                        # T3, P5
    if split is None:
        return j
    j = materialize(j, "cohort")
    if split == "random":                                                                    # R1
        j = R.random_split(j, note_key, validate=validate)
    elif split == "version":                                                                 # J4, R2
        j = P.join_small_dimension(j, versions, join_keys)
        j = R.cohort_split(j, note_key, "site", site, "version", test_version, validate=validate).drop("site", "version")
    else:
        raise ValueError(split)
    if export:                                                                               # S5
        SINK.write_split(j, export)
    return j
