"""Column expressions for the loss ratio, the risk class and label texts (all built-in)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.constants import RISK_CUTS, RISK_KEYWORDS, RISK_LABELS

# Accented Latin letters and their ASCII base letters (after lower-casing).
_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncy"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def loss_ratio(lost: Column | str = "Siniestrada", sown: Column | str = "Sembrada") -> Column:
    """lost / sown clipped to [0, 1]; 0 when sown is 0 or any input is missing."""
    ratio = F.try_divide(_c(lost), F.nullif(_c(sown), F.lit(0.0)))
    return F.coalesce(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def risk_class(ratio: Column | str = "proporcion_siniestro") -> Column:
    """0 for ratio 0; (0,.10] 1; (.10,.40] 2; (.40,.75] 3; else 4 (NULL falls to 4)."""
    r = _c(ratio)
    return (F.when(r == 0, 0).when(r <= RISK_CUTS[0], 1).when(r <= RISK_CUTS[1], 2)
            .when(r <= RISK_CUTS[2], 3).otherwise(4))


def class_label(cls: Column | str) -> Column:
    """Class code 0..4 -> label text."""
    return F.element_at(F.array(*[F.lit(x) for x in RISK_LABELS]), _c(cls).cast("int") + 1)


def normalize_text(col: Column | str) -> Column:
    """Lower-case, fold accented Latin letters to ASCII, drop any other non-ASCII, trim."""
    folded = F.translate(F.lower(_c(col)), _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def label_to_class(col: Column | str, missing: int | None = 0) -> Column:
    """Keyword match on the folded label, in order sin, bajo, medio, alto, else 4.

    Empty / 'nan' / 'none' / NULL give ``missing`` (0 in one variant of the reference,
    NULL -- to be counted and reported -- in the other).
    """
    s = normalize_text(_c(col).cast("string"))
    out = F.when(s.isNull() | s.isin("", "nan", "none"),
                 F.lit(missing).cast("int") if missing is not None else F.lit(None).cast("int"))
    for code, word in enumerate(RISK_KEYWORDS):
        out = out.when(s.contains(word), F.lit(code))
    return out.otherwise(F.lit(4))


def label_report(df, col: str = "nivel_riesgo"):
    """Mapping report for a label column: rows, how many labels are missing (empty / 'nan'
    / 'none' / NULL) and therefore fall back to class 0, and the resulting class counts --
    one operator instead of a silent fallback in one variant and a warning in the other."""
    cls = label_to_class(col, missing=None)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(cls.isNull()).alias("n_unknown"),
                  *[F.count_if(F.coalesce(cls, F.lit(0)) == k).alias(f"n_clase_{k}") for k in range(5)])
