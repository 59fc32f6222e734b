"""Text, rules and settings as column expressions; all stay in the JVM but unified_diff, which is Arrow-batched Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): every line of every text."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def style(text: Column, limit: int) -> Column:
    """Struct of a text's style figures: lines, the longest, how many are over the limit, how many hold a tab."""
    parts = F.split(text, "\n", -1)
    return F.struct(
        F.size(parts).cast("long").alias("n_lines"), F.array_max(F.transform(parts, F.length)).cast("long").alias("longest"),
        F.size(F.filter(parts, lambda x: F.length(x) > limit)).cast("long").alias("long_lines"), F.size(F.filter(parts, lambda x: x.contains("\t"))).cast("long").alias("tabs"),
    )


def hard_coded_path(line: Column) -> Column:
    """The first absolute path in a line, or null."""
    return F.nullif(F.regexp_extract(line, r"(?:^|[\s\"'=(])((?:/[\w.-]+){2,}|[A-Za-z]:\\[\w.\\-]+)", 1), F.lit(""))


def scope(name: Column) -> Column:
    """global or project, from std-global-* and std-project-* names; else null."""
    return F.nullif(F.regexp_extract(name, r"(?:^|/)std-(global|project)-", 1), F.lit(""))


def tier(path: Column) -> Column:
    """historical for archived, old or legacy paths and names, else canonical."""
    return F.when(path.rlike(r"(?i)(^|[/_.-])(archive[sd]?|old|legacy|historical|deprecated)([/_.-]|$)"), "historical").otherwise("canonical")


def resolved(base: Column, target: Column) -> Column:
    """A relative path as seen from the file base, without '.' and '..'; percent signs are decoded. One that leads above the top keeps its '..'."""
    step = lambda at, x: F.when(x.isin(".", ""), at).when((x == "..") & (F.size(at) > 0) & (F.element_at(F.concat(F.array(F.lit("")), at), -1) != ".."), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(x)))
    folder = F.split(base, "/")
    folder = F.slice(folder, 1, F.size(folder) - 1)
    path = F.coalesce(F.try_url_decode(F.regexp_replace(target, r"\+", "%2B")), target)
    return F.array_join(F.aggregate(F.split(path, "/"), folder, step), "/")


def to_deprecate(stage: Column, consumers: Column) -> Column:
    """Whether an asset is a candidate to deprecate: past its scaffold stage it has no consumer."""
    return (F.coalesce(F.size(consumers), F.lit(0)) <= 0) & (stage != "scaffold")


def to_yaml_report(n_sections: Column, ai_facing: Column) -> Column:
    """Whether a report becomes YAML: several sections, and read by tools."""
    return (n_sections > 1) & F.coalesce(ai_facing, F.lit(False))


def bullets_first(text: Column) -> Column:
    """Whether the first line that isn't empty or a heading is a bullet; null if there is none."""
    body = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*#"))
    return F.get(body, F.lit(0)).rlike(r"^\s*[-*]\s")


def prefixed(name: Column, prefix: str) -> Column:
    return name.startswith(prefix)


def redact(text: Column) -> Column:
    """Mail addresses, keys and long digit runs replaced by marks."""
    text = F.regexp_replace(text, r"(?<![\w.+-])[\w.+-]++@[\w-]+(\.[\w-]+)+", "[mail]")  # one try a run of such characters
    text = F.regexp_replace(text, r"(?i)\b(token|secret|password|api[_-]?key)\s*[:=]\s*\S+", "$1=[secret]")
    return F.regexp_replace(text, r"\b\d{12,19}\b", "[number]")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))


def clean_url(url: Column) -> Column:
    """Without query, fragment and a slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/$", "")


def setting(flag: Column, env: Column, default: Column) -> Column:
    """A flag over the environment over the default."""
    return F.coalesce(flag, env, default)


def stage(score: Column, growth: float, mature: float) -> Column:
    return F.when(score >= mature, "mature").when(score >= growth, "growth").otherwise("scaffold")


def leftover_level(strict: bool) -> Column:
    """What a leftover file counts as."""
    return F.lit("FAIL" if strict else "WARN")


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, which order as versions do; a part that isn't a number is 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def stale_days(updated: Column, today: Column) -> Column:
    return F.datediff(today, updated)


def stamp_of(name: Column) -> Column:
    """Time stamp in a name like 'description_2024-05-01_120000.txt'; null without one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{6})\.txt$", 1), F.lit("")), F.lit("yyyy-MM-dd_HHmmss")).cast("timestamp_ntz")


def unified_diff(before: Column, after: Column) -> Column:
    """The unified diff of two texts, '' for equal ones; see operators.patches."""
    from tidemill.operators import patches

    return patches.unified_diff(F.lit("text"), before, after)
