"""Instrument files from transfers (source_well, dest_well, volume_ul, ordinal)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wells
from ..registry import Registry

INSTRUMENTS: Registry[Callable[..., DataFrame]] = Registry("instrument")
#: Least and greatest volume in microlitres.
VOLUMES = {"tecan_evo": (1.0, 950.0), "opentrons": (1.0, 300.0)}


@INSTRUMENTS.register("generic", confidence="verified", suffix=".csv")
def generic(transfers: DataFrame, plate_format: int = 96) -> DataFrame:
    """(ordinal, sub, line): one comma-separated line for each transfer."""
    well = lambda c: wells.normalize(F.col(c), plate_format, strict=True)
    return transfers.select("ordinal", F.lit(0).alias("sub"), F.concat_ws(",", well("source_well"), well("dest_well"), F.format_string("%.2f", F.col("volume_ul"))).alias("line"))


def _two_places(volume: str) -> Column:
    """Through a decimal: a formatter for each line costs more than all else, and is left to what is no positive number of that size."""
    v = F.col(volume)
    return F.coalesce(F.when(v > 0, v.try_cast("decimal(18,2)").cast("string")), F.format_string("%.2f", v.cast("double")))


@INSTRUMENTS.register("tecan_evo", confidence="documented", suffix=".gwl")
def tecan_evo(transfers: DataFrame, plate_format: int = 96, source_label: str = "Source", dest_label: str = "Destination", liquid_class: str = "", wash: bool = True) -> DataFrame:
    """(ordinal, sub, line): aspirate, dispense and wash lines of each transfer; positions run down the columns from 1."""
    volume = _two_places("volume_ul")
    record = lambda letter, label, well: F.concat(F.lit(f"{letter};{label};;;"), F.coalesce(wells.column_major(F.col(well), plate_format).cast("string"), F.lit("null")), F.lit(";;"), volume, F.lit(f";{liquid_class};;;"))
    lines = [record("A", source_label, "source_well"), record("D", dest_label, "dest_well"), *([F.lit("W1;")] if wash else [])]
    return transfers.select("ordinal", F.posexplode(F.array(*lines)).alias("sub", "line"))


@INSTRUMENTS.register("opentrons", confidence="documented", suffix=".py")
def opentrons(transfers: DataFrame, plate_format: int = 96) -> DataFrame:
    """(ordinal, sub, line): the transfer calls of a protocol; ``protocol_text`` puts them into a program."""
    well = lambda c: wells.normalize(F.col(c), plate_format, strict=True)
    return transfers.select("ordinal", F.lit(0).alias("sub"), F.concat(F.lit("    pipette.transfer("), _two_places("volume_ul"), F.lit(', source["'), F.coalesce(well("source_well"), F.lit("null")), F.lit('"], destination["'), F.coalesce(well("dest_well"), F.lit("null")), F.lit('"])')).alias("line"))


def protocol_text(lines: list[str], pipette: str = "p300_single_gen2", tiprack: str = "opentrons_96_tiprack_300ul", labware: str = "corning_96_wellplate_360ul_flat", level: str = "2.14") -> str:
    """A program around transfer calls; the deck slots are to be matched to the real deck."""
    head = ["from opentrons import protocol_api", "", f'metadata = {{"protocolName": "transfer", "apiLevel": "{level}"}}', "", "", "def run(protocol: protocol_api.ProtocolContext):"]
    deck = [f'    {name} = protocol.load_labware("{ware}", {slot})' for name, ware, slot in (("tips", tiprack, 1), ("source", labware, 2), ("destination", labware, 3))]
    return "\n".join([*head, *deck, f'    pipette = protocol.load_instrument("{pipette}", "right", tip_racks=[tips])', *lines]) + "\n"


@INSTRUMENTS.register("integra_vialab", confidence="closed", suffix="")
@INSTRUMENTS.register("hamilton_venus", confidence="closed", suffix="")
@INSTRUMENTS.register("beckman_biomek", confidence="closed", suffix="")
@INSTRUMENTS.register("agilent_bravo", confidence="closed", suffix="")
def closed(transfers: DataFrame, **_) -> DataFrame:
    """Formats without a public description are refused rather than guessed."""
    raise NotImplementedError("this instrument's format is not public; a template is needed")


def emit(transfers: DataFrame, instrument: str, allow_unverified: bool = False, **options) -> DataFrame:
    """Lines for an instrument; one whose format was never held against a real file must be allowed."""
    handler = INSTRUMENTS.get(instrument)
    if INSTRUMENTS.meta(instrument)["confidence"] not in ("verified", "closed") and not allow_unverified:
        raise ValueError(f"{instrument} is {INSTRUMENTS.meta(instrument)['confidence']}, not verified")
    return handler(transfers, **options)


def check_volumes(transfers: DataFrame, low: float, high: float) -> DataFrame:
    """One row: transfers, how many are below and above the limits, least and greatest volume."""
    return transfers.agg(F.count("*").alias("n"), F.count_if(F.col("volume_ul") < low).alias("below"), F.count_if(F.col("volume_ul") > high).alias("above"), F.min("volume_ul").alias("min_ul"), F.max("volume_ul").alias("max_ul"))


def available() -> list[dict]:
    order = ("verified", "documented", "closed")
    return sorted(({"instrument": n, **INSTRUMENTS.meta(n)} for n in INSTRUMENTS), key=lambda r: (order.index(r["confidence"]), r["instrument"]))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, in order. A worklist is a few thousand lines."""
    lines.orderBy("ordinal", "sub").select("line").coalesce(1).write.mode("overwrite").text(path)
