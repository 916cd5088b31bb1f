"""Context generation that can be stopped, paused and gone on with: work is leased part by part, results are committed as they come."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as texts
from spindrift.sources.store import Store

#: Makes (chunk_id, context) of (chunk_id, url, text, document); a chunk it leaves out, or with a short context, has none.
Writer = Callable[[DataFrame], DataFrame]

RESULTS = "chunk_id string, cache_key string, context string"
WORK = "chunk_id string, url string, text string, document string, cache_key string, part long"
#: What a run ended with.
DONE, PAUSED, STOPPED, LEASED = "done", "paused", "stopped", "leased"


@dataclass(frozen=True)
class ContextJob:
    """The contexts of one corpus in ``folder``: a work table of what is missing, in parts of about ``save_every`` chunks, and
    results.  A part is leased before it is worked on and given back with its result in one commit, so several runs can share
    the work, and a run that is lost costs the parts it held, which others take over when their leases end."""

    spark: SparkSession
    folder: str
    save_every: int = 50
    lease_seconds: float = 3600.0
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    clock: Callable[[], float] = time.time

    @property
    def store(self) -> Store:
        return Store(self.spark, self.folder)

    def _state(self) -> dict:
        last = self.store.state()
        return last[1] if last else {"results": [], "work": None, "parts": 0, "done": [], "leases": {}, "paused": False, "stopped": False}

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        return self.store.transact(lambda _, state: change(state or self._state()))[1]

    # ---- control

    def pause(self) -> None:
        """Runs end after the part they are at, until ``resume``."""
        self._commit(lambda s: s | {"paused": True})

    def resume(self) -> None:
        self._commit(lambda s: s | {"paused": False, "stopped": False})

    def stop(self) -> None:
        """As pause, but leases of runs that are gone are given back, too."""
        self._commit(lambda s: s | {"stopped": True, "leases": {}})

    def clear(self) -> None:
        """Forgets all contexts."""
        self._commit(lambda s: s | {"results": [], "work": None, "parts": 0, "done": [], "leases": {}})

    def status(self) -> dict:
        s = self._state()
        return {"parts": s["parts"], "done": len(s["done"]), "leased": len(s["leases"]), "paused": s["paused"], "stopped": s["stopped"], "contexts": self.contexts().count()}

    # ---- work

    def contexts(self) -> DataFrame:
        """(chunk_id, cache_key, context) so far."""
        return self.store.read("results", self._state()["results"], RESULTS)

    def plan(self, rows: DataFrame, documents: DataFrame) -> int:
        """Writes what is missing of chunks (chunk_id, url, text) with a document (url, document) as the work table, in place of
        one that was not finished; the number of its parts.  Contexts that are there under the chunk's id and text are kept,
        and chunks without a document are not asked for."""
        keyed = rows.select("chunk_id", "url", "text", texts.context_key(F.col("chunk_id"), F.col("text")).alias("cache_key"))
        missing = keyed.join(documents.select("url", "document"), "url").dropDuplicates(["cache_key"])

        def change(state: dict) -> dict:
            known = self.store.read("results", state["results"], RESULTS).select("cache_key")
            left = missing.join(known, "cache_key", "left_anti")
            parts = -(-left.count() // self.save_every)
            dealt = left.withColumn("part", F.pmod(F.xxhash64("cache_key"), F.lit(max(1, parts)))).select(*(c.split()[0] for c in WORK.split(", ")))
            batch = self.store.write("work", dealt.repartitionByRange("part"))
            return state | {"work": batch, "parts": parts, "done": [], "leases": {}}

        return self._commit(change)["parts"]

    def _leased(self) -> tuple[int | None, dict]:
        """A part that no other run holds, leased; none where all are done or held, or a pause or stop is asked for."""
        taken: list[int] = []

        def change(state: dict) -> dict | None:
            taken.clear()
            if state["paused"] or state["stopped"]:
                return None
            now, done = self.clock(), set(state["done"])
            held = {int(p) for p, (owner, until) in state["leases"].items() if until > now and owner != self.owner}
            part = next((p for p in range(state["parts"]) if p not in done and p not in held), None)
            if part is None:
                return None
            taken.append(part)
            return state | {"leases": state["leases"] | {str(part): [self.owner, now + self.lease_seconds]}}

        if self.store.state() is None:
            return None, self._state()
        state = self._commit(change)
        return (taken[0] if taken else None), state

    def run(self, write: Writer) -> str:
        """Works on part after part; how it ended.  Each part is one job over its chunks, asked for once unless a run that held
        it was lost."""
        while True:
            part, state = self._leased()
            if part is None:
                if state["stopped"] or state["paused"]:
                    return STOPPED if state["stopped"] else PAUSED
                return DONE if len(state["done"]) >= state["parts"] else LEASED
            own = self.store.read("work", [state["work"]], WORK).where(F.col("part") == part)
            made = write(own.select("chunk_id", "url", "text", "document")).select("chunk_id", texts.valid_context(F.col("context")).alias("context"))
            # a chunk whose context is not valid is not asked for again in this work
            found = made.where("context is not null").join(own.select("chunk_id", "cache_key"), "chunk_id").select("chunk_id", "cache_key", "context")
            batch, work = self.store.write("results", found), state["work"]

            def finish(now: dict, part=part, batch=batch, work=work) -> dict | None:
                holder = now["leases"].get(str(part), [None])[0]
                if now["work"] != work or part in now["done"] or holder not in (self.owner, None):
                    return None  # planned anew, or another run took the part over: its result counts
                return now | {"results": [*now["results"], batch], "done": [*now["done"], part], "leases": {p: v for p, v in now["leases"].items() if p != str(part)}}

            self._commit(finish)
