"""Batch jobs: requests leave as one job, answers come back later.

A job's requests are written as JSON lines below ``path``/<key>, the key being a
digest of codebook and options. The service gets the folder, returns a job's
name, and later puts answers (unit_id and the schema's fields) into another.
The name is kept beside the requests, so the same call goes on with the same job
after the session has ended.
"""

from __future__ import annotations

import json
import time
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotrail.plans.codebook import Codebook
from annotrail.session import exists, read_text, write_text


class Service(Protocol):
    def submit(self, requests: str, prompt: str, options: dict) -> str:
        """Take the requests in a folder; the name of the job."""

    def answers(self, job: str) -> str | None:
        """The folder with the answers as JSON lines; None as long as the job isn't done."""


class BatchPending(Exception):
    """The job isn't done; the same call goes on with it later."""

    def __init__(self, job: str):
        super().__init__(f"job {job!r} is not done yet; call again to go on with it")
        self.job = job


class BatchBackend:
    """Codes from batch jobs of a service.

    ``wait`` (an option of the run) waits for the answers, otherwise ``BatchPending`` is raised. The
    units of a job are kept with it: a call with other units raises, unless ``ignore_hash`` is given.
    """

    def __init__(self, service: Service, path: str, pause: float = 30.0):
        self.service, self.path, self.pause = service, path.rstrip("/"), pause

    def answer(self, units: DataFrame, codebook: Codebook, options: dict) -> DataFrame:
        from annotrail.plans.coding import digest

        spark = units.sparkSession
        folder = f"{options.get('path', self.path).rstrip('/')}/{digest(codebook.json(), options.get('chat'))[:16]}"
        asked = units.select("unit_id", "content")
        mark = self._mark(asked)
        if exists(spark, f"{folder}/job.json"):
            kept = json.loads(read_text(spark, f"{folder}/job.json"))
            if kept["units"] != mark and not options.get("ignore_hash"):
                raise ValueError("the job was sent for other units; pass ignore_hash=True to use its answers")
        else:
            asked.write.mode("overwrite").json(f"{folder}/requests")
            kept = {"job": self.service.submit(f"{folder}/requests", codebook.prompt(), options), "units": mark}
            write_text(spark, f"{folder}/job.json", json.dumps(kept))
        found = self.service.answers(kept["job"])
        while found is None and options.get("wait", True):
            time.sleep(self.pause)
            found = self.service.answers(kept["job"])
        if found is None:
            raise BatchPending(kept["job"])
        return self._with(spark, units, codebook, found)

    def _mark(self, asked: DataFrame) -> str:
        """A name of the units, whatever their order: sums of the halves of their hashes."""
        name = F.xxhash64("unit_id", "content")
        row = asked.agg(F.count("*").alias("n"), F.sum(name.bitwiseAND(F.lit(0xFFFFFFFF))).alias("a"), F.sum(F.shiftrightunsigned(name, 32)).alias("b")).first()
        return f"{row['n']}-{row['a']}-{row['b']}"

    def _with(self, spark: SparkSession, units: DataFrame, codebook: Codebook, folder: str) -> DataFrame:
        kinds = ", ".join(["unit_id string", *(f"`{n}` {k.spark().simpleString()}" for n, k in codebook.schema.fields)])
        codes = spark.read.schema(kinds).json(folder).dropDuplicates(["unit_id"])
        codes = codes.select("unit_id", F.struct(*[F.col(f"`{n}`") for n, _ in codebook.schema.fields]).alias("codes"))
        return units.join(codes, "unit_id", "left")
