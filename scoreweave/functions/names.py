"""Scalar functions on names, dates and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of a chart's axis, where they differ from the metric's name (fixed values).
AXIS_LABELS = {
    "Cost of 1K responses": "Cost of 1K Responses ($)",
    "Completion Latency": "Time to give an answer (seconds)",
    "Input cost": "Input Cost ($/M tokens)",
    "Output cost": "Output Cost ($/M tokens)",
    "Size": "Size (Billion Parameters)",
    "Active parameters": "Billion Active Parameters",
    "Release date": "Release Date (Year)",
}

#: Colours of companies (fixed values).
COMPANY_COLORS = {
    "OpenAI": "hsl(223, 75%, 22%)",
    "Anthropic": "hsl(15, 52%, 58%)",
    "Google": "hsl(136, 53%, 43%)",
    "Mistral AI": "hsl(17, 96%, 52%)",
    "xAI": "hsl(213, 4%, 57%)",
    "Alibaba": "hsl(242, 80%, 65%)",
    "DeepSeek": "hsl(230, 80%, 52%)",
    "Moonshot AI": "hsl(212, 99%, 51%)",
    "MiniMax": "hsl(343, 82%, 56%)",
    "Z.ai": "hsl(274, 100%, 50%)",
    "Cohere": "hsl(159, 21%, 28%)",
    "AllenAI": "hsl(331, 84%, 63%)",
    "Hugging Face": "hsl(48, 100%, 56%)",
    "Microsoft": "hsl(199, 96%, 48%)",
    "NVIDIA": "hsl(82, 100%, 36%)",
    "Baidu": "hsl(237, 75%, 52%)",
    "Thinking Machines": "hsl(37, 80%, 66%)",
    "Liquid": "hsl(251, 69%, 59%)",
}


def normalize_name(name: Column) -> Column:
    """Lower case, without the first run of eight digits; separators are single blanks."""
    dated = F.regexp_replace(F.lower(name), r"(?s)^(.*?)[0-9]{8}", "$1")
    return F.regexp_replace(F.regexp_replace(F.translate(dated, "-._", "   "), r"(?U)\s+", " "), r"^ | $", "")


def capitalize(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def slug(company: Column) -> Column:
    """File name of a company: lower case without blanks and dots."""
    return F.regexp_replace(F.lower(company), r"[\s.]", "")


def year_fraction(day: Column) -> Column:
    """A date as a year with its elapsed share."""
    start = lambda n: F.make_date(F.year(day) + n, F.lit(1), F.lit(1))
    return F.year(day) + F.datediff(day, start(0)) / F.datediff(start(1), start(0))


def age_alpha(day: Column, as_of: Column) -> Column:
    """1 for today down to 0 a year ago; 0.7 without a date."""
    return F.when(day.isNull(), F.lit(0.7)).otherwise(F.greatest(F.lit(0.0), 1 - F.datediff(as_of, day) / F.lit(365.0)))


def axis_label(metric: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in AXIS_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(table, metric), metric)


def axis_scale(metric: Column) -> Column:
    return F.when(metric == "Release date", "linear").otherwise("logarithmic")


def hue(text: Column) -> Column:
    """A stable hue for a name: a rolling hash of 32 bits whose product wraps, modulo 360 (it may be negative)."""
    # Only the shifted part wraps; sums stay exact as whole numbers.
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: c + wrap(wrap(h) * 32) - h) % 360


def company_color(company: Column) -> Column:
    """A company's colour; one of a stable hue if it has none."""
    table = F.create_map(*[F.lit(x) for pair in COMPANY_COLORS.items() for x in pair])
    return F.coalesce(F.element_at(table, company), F.concat(F.lit("hsl("), hue(company).cast("string"), F.lit(", 70%, 60%)")))
