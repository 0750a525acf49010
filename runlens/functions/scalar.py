"""Column expressions that several operators share.  Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A trimmed cell as a double; what is no number is null, and so is NaN."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def file_run(name: Column) -> Column:
    """Run number of a data file name, in any case; null where it does not parse."""
    return F.nullif(F.regexp_extract(name, r"(?i)Digitizer_run(\d+)_subrun(\d+)", 1), F.lit("")).try_cast("int")


def file_subrun(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)Digitizer_run(\d+)_subrun(\d+)", 2), F.lit("")).try_cast("int")


def any_run(name: Column) -> Column:
    """The first run number anywhere in a name."""
    return F.nullif(F.regexp_extract(name, r"(?i)run(\d+)", 1), F.lit("")).try_cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bit(word: Column, position: int | Column) -> Column:
    """Bit ``position`` (0 is the lowest) of a trigger word; null for a null word."""
    return F.shiftrightunsigned(word, position).bitwiseAND(F.lit(1)) if isinstance(position, int) else F.getbit(word, position)


def guarded(value: Column, by: Column) -> Column:
    """value / by where by is positive, else null."""
    return F.when(by > 0, value / by)


def channel_number(channel: Column) -> Column:
    """Integer of a channel name, null for pseudo-channels."""
    return channel.try_cast("int")


def compact(value: Column) -> Column:
    """Short text of a number: '' if null, 0, scientific where large or small, else one, two or three digits."""
    size = F.abs(value)
    return (
        F.when(value.isNull(), "")
        .when(value == 0, "0")
        .when((size >= 1e4) | (size < 1e-2), F.format_string("%.1e", value))
        .when(size >= 100, F.format_string("%.1f", value))
        .when(size >= 1, F.format_string("%.2f", value))
        .otherwise(F.format_string("%.3f", value))
    )


def row_offset(row: Column, channel: Column) -> Column:
    """Place of a channel on the map: even channels a bit above their row, odd ones below."""
    return row + F.when(channel % 2 == 0, 0.2).otherwise(-0.2)


def clipped(z: Column, most: float = 50.0) -> Column:
    """|z|, at most ``most``; null stays null."""
    return F.when(z.isNotNull(), F.least(F.abs(z), F.lit(most)))


def half_even(value: Column, places: int) -> Column:
    """Rounded as the binary value of a double says, exact halves to even: 2.675 (below its decimal) gives 2.67.

    value * 10 ** places is taken with its exact error, by splitting value into
    two halves whose products are exact; only where the product is a half does
    the error decide.
    """
    by = float(10**places)

    def of(x: Column) -> Column:
        wide = x * F.lit(134217729.0)
        high = wide - (wide - x)
        low = x - high
        product = x * by
        error = (high * by - product) + low * by
        down = F.floor(product).cast("double")
        nearest = F.when((product - down == 0.5) & (error > 0), down + 1).when((product - down == 0.5) & (error < 0), down).otherwise(F.rint(product))
        return nearest / by

    return F.when(F.abs(value) < 1e12, of(value)).otherwise(value)


def utc_stamp(at: Column | None = None) -> Column:
    """ISO-8601 with seconds, in UTC whatever the session's time zone."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def tag_fields(tag: Column) -> dict[str, Column]:
    """Parameters that a model tag carries, such as ``..._ifContamination_0p01_zThreshold_6sigma_alertConsec_3_noLVDS``; null or false where it has none."""

    def got(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(tag, pattern, 1), F.lit(""))

    # fixed values: the parts of a tag
    return {
        "contamination": F.replace(got(r"ifContamination_([0-9p]+)"), F.lit("p"), F.lit(".")).try_cast("double"),
        "z_threshold": got(r"zThreshold_(\d+)sigma").try_cast("double"),
        "consecutive": got(r"alertConsec_(\d+)").try_cast("int"),
        "n_trees": got(r"nEst_(\d+)").try_cast("int"),
        "max_samples": got(r"maxSamp_(\d+)").try_cast("int"),
        "quality": got(r"_(Loose|Medium|Tight|All)(?:_|$)"),
        "use_trigger": ~tag.contains("_noTrigger"),
        "use_lvds": ~tag.contains("_noLVDS"),
        "use_trigger_config": ~tag.contains("_ignoreTriggerConfig"),
    }


def with_tag_fields(models: DataFrame, tag: str = "tag", needed: tuple[str, ...] = ("contamination", "z_threshold")) -> DataFrame:
    """Models with their tag's parameters; tags without the ``needed`` ones drop out, so sweeps of other kinds can be united."""
    rows = models.withColumns(tag_fields(F.col(tag)))
    for name in needed:
        rows = rows.where(F.col(name).isNotNull())
    return rows
