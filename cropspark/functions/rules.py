"""Documented rules of the domain as CASE expressions. A missing input never triggers a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark import constants as K


def enso_phase(index: Column) -> Column:
    return (F.when(index >= K.ENSO_THRESHOLD, K.ENSO_EL_NINO)
            .when(index <= -K.ENSO_THRESHOLD, K.ENSO_LA_NINA)
            .when(index.isNotNull(), K.ENSO_NEUTRAL))


def _points(*steps: tuple[Column, int]) -> Column:
    out = None
    for condition, points in steps:
        out = F.when(condition, points) if out is None else out.when(condition, points)
    return out.otherwise(0)


def risk_score(spi: Column, rain_anomaly: Column, tmax: Column, phase: Column) -> Column:
    """0 low, 1 medium, 2 high: the sum of the rules whose inputs exist."""
    total = (
        _points((spi < -1.5, 3), (spi < -1.0, 2), (spi < -0.5, 1))
        + _points((spi > 1.5, 2), (spi > 1.0, 1))
        + _points((F.abs(rain_anomaly) > 50, 2), (F.abs(rain_anomaly) > 25, 1))
        + _points((tmax > 38, 2), (tmax > 35, 1))
        + _points((phase.isin(K.ENSO_EL_NINO, K.ENSO_LA_NINA), 1))
    )
    return _points((total >= 5, 2), (total >= 2, 1))


def event_type(spi: Column, rain_anomaly: Column, tmax: Column, tmin: Column, humidity: Column) -> Column:
    return (
        F.when((spi < -1.0) | (rain_anomaly < -40), K.EVENT_DROUGHT)
        .when((spi > 1.0) | (rain_anomaly > 50), K.EVENT_EXCESS_RAIN)
        .when((tmax > 36) | (tmin < 4), K.EVENT_HEAT)
        .when((humidity > 80) & tmax.between(22, 32), K.EVENT_PESTS)
        .otherwise(K.EVENT_NONE)
    )


def risk_label(score: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in K.RISK_LABELS]), score.cast("int") + 1)


def confidence_class(improvement: Column) -> Column:
    return (F.when(improvement >= K.CONFIDENCE_HIGH, "alta")
            .when(improvement >= K.CONFIDENCE_MEDIUM, "media").otherwise("baja"))


def effect_label(eta2: Column) -> Column:
    return (F.when(eta2.isNull() | F.isnan(eta2), "n/d").when(eta2 < 0.01, "insignificante")
            .when(eta2 < 0.06, "pequeño").when(eta2 < 0.14, "mediano").otherwise("grande"))


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def ordinal_score(label: Column, scores: dict[str, int] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (scores or K.SUITABILITY_SCORE).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), label).cast("double")


def flag_number(c: Column) -> Column:
    """true 1.0, false 0.0, missing stays missing."""
    return c.cast("double")


def suitability_class(c: Column) -> Column:
    text = F.lower(c)
    return (
        F.when(text.contains("alta"), "alta")
        .when(text.contains("media") | text.contains("moderada"), "moderada")
        .when(text.contains("baja") | text.contains("marginal"), "marginal")
        .when(text.isNotNull(), "no_apta")
    )


def input_type(c: Column) -> Column:
    """Kind of farm input from the name of its price index."""
    name = F.lower(c)
    words = "|".join(K.FERTILISER_WORDS)
    return (F.when(name.startswith("_") | name.rlike(words), "Fertilizante")
            .when(name.rlike("|".join(K.PESTICIDE_WORDS)), "Plaguicida").otherwise("Otros"))


def fertiliser_dose(suitability: Column, deficit_probability: Column) -> Column:
    pairs = [F.lit(x) for kv in K.SUITABILITY_DOSE.items() for x in kv]
    base = F.coalesce(F.try_element_at(F.create_map(*pairs), suitability), F.lit(K.DEFAULT_DOSE))
    return base + F.when(deficit_probability > K.DEFICIT_THRESHOLD, K.DEFICIT_DOSE_STEP).otherwise(0)


def freshness_state(delay_bdays: Column) -> Column:
    return (F.when(delay_bdays.isNull(), "sin_datos").when(delay_bdays <= 1, "al_dia")
            .when(delay_bdays == 2, "retrasado").otherwise("desactualizado"))


def threshold_state(value: Column, low: Column, high: Column) -> Column:
    return (F.when(value.isNull(), "SIN_DATOS").when((value < low) | (value > high), "ALERTA").otherwise("OK"))


def completeness_state(rows: Column, duplicate_share: Column, completeness: Column) -> Column:
    return (F.when(rows == 0, "sin_datos").when(duplicate_share > 0.05, "duplicados")
            .when(completeness < 80, "incompleto").when(completeness < 95, "parcial").otherwise("ok"))
