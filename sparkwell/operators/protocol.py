"""Laboratory steps as pure plans: what plates, wells and transfers a step would make; nothing is written until it is committed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.ids import mint
from ..registry import Registry
from .plates import normalise_plan

STEPS: Registry[type] = Registry("step")
#: Fixed value: the order of a campaign.
CHAIN = ("transfect", "harvest_supernatant", "add_beads", "immunoprecipitate", "elute_neutralise", "magnet_transfer", "quantify_bli", "normalise")


@dataclass
class Plan:
    """Lazy frames of a step: the wells of its output plate, if it has one, and its transfers."""

    step: str
    source_id: str
    output_id: str | None
    wells: DataFrame | None
    transfers: DataFrame | None
    params: dict = field(default_factory=dict)

    @property
    def in_place(self) -> bool:
        return self.output_id is None


class Step:
    """Base: ``content`` is what the input plate must hold, ``gives`` what the output holds."""

    name, content, gives = "", "", ""

    def check(self, content_kind: str) -> None:
        if content_kind != self.content:
            raise ValueError(f"{self.name} takes a plate of {self.content}, not of {content_kind}")

    def wells(self, source: DataFrame, **params) -> DataFrame:
        """The wells of the output: source wells with samples, their clones and volumes."""
        raise NotImplementedError

    def plan(self, source: DataFrame, plate_id: str, content_kind: str, output_id: str | None = None, **params) -> Plan:
        self.check(content_kind)
        output = output_id or mint("PLT")
        made = self.wells(source, **params)
        wells = made.select(F.lit(output).alias("plate_id"), "well", "role", "clone_id", "volume_ul", F.lit(plate_id).alias("source_plate_id"), F.col("well").alias("source_well"))
        moved = made.where("moved_ul > 0").select(F.lit(plate_id).alias("source_plate_id"), F.col("well").alias("source_well"), F.lit(output).alias("dest_plate_id"), F.col("well").alias("dest_well"), F.col("moved_ul").alias("volume_ul"))
        return Plan(self.name, plate_id, output, wells, moved, params)


def _carried(source: DataFrame, volume: F.Column, moved: F.Column) -> DataFrame:
    sample = F.col("role") == "sample"
    return source.select("well", "role", "clone_id", F.when(sample, volume).alias("volume_ul"), F.when(sample, moved).otherwise(0.0).cast("double").alias("moved_ul"))


def _register(name: str, content: str, gives: str, volume, moved):
    """A step that keeps the layout: ``volume`` and ``moved`` are made from its parameters."""

    def wells(self: Step, source: DataFrame, **params) -> DataFrame:
        return _carried(source, volume(params), moved(params))

    cls = type(name.title().replace("_", ""), (Step,), {"name": name, "content": content, "gives": gives, "wells": wells, "__doc__": f"{content} to {gives}, well by well."})
    return STEPS.register(name, content=content, gives=gives)(cls)


_register("transfect", "dna", "culture", lambda p: F.lit(float(p.get("volume_ul", 1000.0))), lambda p: F.lit(float(p.get("dna_ul", 5.0))))
_register("harvest_supernatant", "culture", "supernatant", lambda p: F.lit(float(p.get("volume_ul", 800.0))), lambda p: F.lit(float(p.get("volume_ul", 800.0))))
_register("add_beads", "supernatant", "bead_slurry", lambda p: F.coalesce(F.col("volume_ul"), F.lit(0.0)) + float(p.get("bead_slurry_ul", 20.0)), lambda p: F.lit(0.0))
_register("immunoprecipitate", "bead_slurry", "bound_beads", lambda p: F.col("volume_ul"), lambda p: F.lit(0.0))
_register("elute_neutralise", "bound_beads", "eluate", lambda p: F.lit(float(p.get("elution_ul", 50.0)) + float(p.get("neutralisation_ul", 5.0))), lambda p: F.lit(0.0))
_register("magnet_transfer", "eluate", "purified", lambda p: F.lit(float(p.get("volume_ul", 50.0))), lambda p: F.lit(float(p.get("volume_ul", 50.0))))


@STEPS.register("quantify_bli", content="purified", gives="purified")
class QuantifyBli(Step):
    """A reading in place: no plate and no transfer comes of it."""

    name, content, gives = "quantify_bli", "purified", "purified"

    def plan(self, source: DataFrame, plate_id: str, content_kind: str, output_id: str | None = None, **params) -> Plan:
        self.check(content_kind)
        return Plan(self.name, plate_id, None, None, None, params)


@STEPS.register("normalise", content="purified", gives="normalised")
class Normalise(Step):
    """Dilution to one concentration; wells without a measured one get no transfer."""

    name, content, gives = "normalise", "purified", "normalised"

    def wells(self, source: DataFrame, **params) -> DataFrame:
        amounts = normalise_plan(source.where("role = 'sample'"), **params).select("well", "sample_ul", "flag")
        total = float(params.get("target_volume_ul", 100.0))
        joined = source.select("well", "role", "clone_id").join(amounts, "well", "left")
        return joined.select("well", "role", "clone_id", F.when(F.col("sample_ul").isNotNull(), F.lit(total)).alias("volume_ul"), F.coalesce("sample_ul", F.lit(0.0)).alias("moved_ul"), "flag")


def available() -> list[dict]:
    return [{"step": n, **STEPS.meta(n)} for n in STEPS]


def commit(plan: Plan, spark: SparkSession, folder: str) -> str:
    """Write a plan under ``folder``: wells, transfers and one step row, in folders of the run's own; returns the run's id."""
    run = mint("RUN")
    if plan.wells is not None:
        plan.wells.write.parquet(f"{folder}/wells/run={run}")
        # a plate's transfers, numbered in the order in which they are made
        ordinal = F.row_number().over(W.Window.partitionBy("dest_plate_id").orderBy(F.substring("dest_well", 2, 2), "dest_well"))
        plan.transfers.withColumn("ordinal", ordinal - 1).write.parquet(f"{folder}/transfers/run={run}")
    row = [(run, plan.step, "planned", json.dumps([plan.source_id]), json.dumps([plan.output_id] if plan.output_id else []), json.dumps(plan.params, sort_keys=True))]
    spark.createDataFrame(row, "run_id string, step_type string, status string, inputs_json string, outputs_json string, params_json string").write.parquet(f"{folder}/steps/run={run}")
    return run
