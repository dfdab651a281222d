"""Label coding, fixed buckets and small scalar rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class ids and names.
CLASS_NAMES = {0: "neg", 1: "neu", 2: "pos"}
CLASSES = (0, 1, 2)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_to_label(rating: Column | str) -> Column:
    """1-2 stars 0, 3 stars 1, 4-5 stars 2."""
    r = _col(rating)
    return F.when(r <= 2, 0).when(r == 3, 1).otherwise(2)


def recode(value: Column | str, mapping: Mapping, default=None) -> Column:
    """Map values through a small literal table; anything else becomes ``default``."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    hit = F.try_element_at(table, _col(value))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def decode_class(y: Column | str) -> Column:
    return recode(y, CLASS_NAMES)


def encode_label(label: Column | str, names: Sequence[str] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> Column:
    """Class id of an upper-cased label name, null for names outside the list."""
    return recode(F.upper(_col(label)), {n: i for i, n in enumerate(names)})


def bucket(value: Column | str, edges: Sequence, labels: Sequence[str]) -> Column:
    """First label whose upper edge (inclusive) holds the value; the last label takes the rest."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    v = _col(value)
    out = F
    for edge, label in zip(edges, labels):
        out = out.when(v <= edge, label)
    return out.otherwise(labels[-1])


def dup_type(n_rows: Column | str, n_users: Column | str, n_parent: Column | str) -> Column:
    """Who shares a text: nobody, one user on one product, one user across products, several users."""
    rows, users, parents = _col(n_rows), _col(n_users), _col(n_parent)
    return (
        F.when(rows == 1, "0_unique")
        .when((users == 1) & (parents == 1), "1_same_user_same_parent")
        .when(users == 1, "2_same_user_cross_product")
        .otherwise("3_cross_user")
    )


def group_size(n_rows: Column | str, edges: Sequence[int] = (1, 5, 20, 100)) -> Column:
    lows = [1] + [e + 1 for e in edges[:-1]]
    names = [str(hi) if lo == hi else f"{lo}-{hi}" for lo, hi in zip(lows, edges)] + [f">{edges[-1]}"]
    return bucket(n_rows, edges, names)


def rating_agreement(sd: Column | str) -> Column:
    s = _col(sd)
    return F.when(s == 0, "identical rating").when(s < 1, "sd<1").otherwise("sd>=1")


def period(yr: Column | str, early_until: int = 2016, late: tuple[int, int] = (2019, 2022)) -> Column:
    y = _col(yr)
    return F.when(y <= early_until, "early").when(y.between(*late), "late")


def pred_from_probs(probs: Sequence[Column | str], classes: Sequence[int] = CLASSES) -> Column:
    """Class of the largest probability; the first one wins a tie."""
    cols = [_col(p) for p in probs]
    top = F.greatest(*cols)
    out = F
    for p, c in zip(cols, classes):
        out = out.when(p == top, c)
    return out


def binary_pred(p_neg: Column | str = "p_neg", p_pos: Column | str = "p_pos") -> Column:
    """0 when negative is strictly more likely than positive, else 2."""
    return F.when(_col(p_neg) > _col(p_pos), 0).otherwise(2)


def aspect_gold(polarities: Column | str) -> Column:
    """One sentence label from the polarities of its aspects; null when there is none."""
    p = F.array_distinct(_col(polarities))
    has = lambda name: F.array_contains(p, name)
    return (
        F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(has("conflict") | (has("positive") & has("negative")), "MIXED")
        .when((F.size(p) == 1) & has("neutral"), "NEUTRAL")
        .when(has("positive"), "POSITIVE")
        .otherwise("NEGATIVE")
    )


def flag(value: Column | str) -> Column:
    """1 for a true flag in boolean or text form, else 0."""
    return (F.lower(_col(value).cast("string")) == "true").cast("int")


def array_element(arr: Column | str, i: int, default: str = "(none)") -> Column:
    """1-based element; short arrays, nulls and empty strings give the default."""
    return F.coalesce(F.nullif(F.try_element_at(_col(arr), F.lit(i)), F.lit("")), F.lit(default))


def length_features(length: Column | str) -> tuple[Column, Column]:
    """log(1+len) and its square."""
    x = F.log1p(_col(length).cast("double"))
    return x, x * x
