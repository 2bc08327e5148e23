"""Fair share: who owns how much, and which moves bring a worker to its share.

The snapshot is relational.  The plan is a short sequence in which each move depends on
those before, over one row per ready shard; it is folded on the driver, like any planner.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .leases import step as lease_step

ACQUIRE, CLAIM, SHED = "acquire_unowned", "claim_donor", "shed"


def owned(ready: DataFrame, leases: DataFrame) -> DataFrame:
    """shard_id and owner of ready shards; owners need not be live workers."""
    return ready.join(leases.select("shard_id", F.nullif(F.col("owner"), F.lit("")).alias("owner")), "shard_id", "left")


def shares(ready: DataFrame, leases: DataFrame, workers: DataFrame, self_owner: str) -> DataFrame:
    """One row: active_workers, open, low, high, owned (by self) and unowned."""
    spark = ready.sparkSession
    me = spark.range(1).select(F.lit(self_owner).alias("owner"))
    active = workers.select("owner").union(me).agg(F.count_distinct("owner").alias("active_workers"))
    state = owned(ready, leases).agg(F.count("*").alias("open"), F.count_if(F.col("owner") == self_owner).alias("owned"), F.count_if(F.col("owner").isNull()).alias("unowned"))
    one = active.withColumn("_one", F.lit(1)).join(state.withColumn("_one", F.lit(1)), "_one")
    low = F.floor(F.col("open") / F.col("active_workers")).cast("long")
    high = F.ceil(F.col("open") / F.col("active_workers")).cast("long")
    return one.select("active_workers", "open", low.alias("low"), high.alias("high"), "owned", "unowned")


def owners(ready: DataFrame, leases: DataFrame) -> DataFrame:
    """owner, shard_count and sorted shard_ids."""
    by = owned(ready, leases).filter(F.col("owner").isNotNull()).groupBy("owner")
    return by.agg(F.count("*").alias("shard_count"), F.array_join(F.sort_array(F.collect_list("shard_id")), ",").alias("shard_ids"))


def pick_donor(ready: DataFrame, leases: DataFrame, threshold: int, self_owner: str) -> DataFrame:
    """The owner with most shards, above the threshold and not self; of equals the least name."""
    candidates = owners(ready, leases).filter((F.col("shard_count") > threshold) & (F.col("owner") != self_owner))
    return candidates.orderBy(F.desc("shard_count"), "owner").limit(1).select("owner", "shard_count")


def eligible(shards: DataFrame, cooldown: DataFrame, local: DataFrame, now) -> DataFrame:
    """Without shards that cool down or have a worker here, even one that stops."""
    cooling = cooldown.filter(F.col("until") > F.lit(now).cast("timestamp")).select("shard_id")
    return shards.join(cooling, "shard_id", "left_anti").join(local.select("shard_id"), "shard_id", "left_anti")


def first_of(shards: DataFrame, budget: DataFrame) -> DataFrame:
    """The first shards by id, as many as the one row of ``budget`` says; over one row per ready shard of one stream."""
    ranked = shards.select("shard_id", F.row_number().over(Window.orderBy("shard_id")).alias("_rank"), F.lit(1).alias("_one"))
    return ranked.join(budget.withColumn("_one", F.lit(1)), "_one").filter(F.col("_rank") <= F.col("budget")).select("shard_id")


def sync_acquire(ready: DataFrame, leases: DataFrame, workers: DataFrame, self_owner: str, cooldown: DataFrame, local: DataFrame, now) -> DataFrame:
    """Unowned shards to acquire at a sync: the first eligible ones up to the high share."""
    budget = shares(ready, leases, workers, self_owner).select((F.col("high") - F.col("owned")).alias("budget"))
    free = owned(ready, leases).filter(F.col("owner").isNull()).select("shard_id")
    return first_of(eligible(free, cooldown, local, now), budget)


def shed(ready: DataFrame, leases: DataFrame, workers: DataFrame, self_owner: str, cooldown: DataFrame, local: DataFrame, now, moves: int) -> DataFrame:
    """Own shards to give up: those above the high share, running and not cooling, at most ``moves``."""
    budget = shares(ready, leases, workers, self_owner).select(F.least(F.col("owned") - F.col("high"), F.lit(moves)).alias("budget"))
    mine = owned(ready, leases).filter(F.col("owner") == self_owner).select("shard_id")
    cooling = cooldown.filter(F.col("until") > F.lit(now).cast("timestamp")).select("shard_id")
    running = local.filter("not stopping").select("shard_id")
    rows = mine.join(cooling, "shard_id", "left_anti").join(running, "shard_id", "left_semi")
    return first_of(rows, budget)


@dataclass
class Snapshot:
    """The state that a plan starts from."""

    ready: list[str]
    lease_owners: dict[str, str]
    workers: list[str]
    self_owner: str
    blocked: set[str] = field(default_factory=set)  # cooling, or with a worker here

    def __post_init__(self) -> None:
        self.active = len({*self.workers, self.self_owner})
        self.low, self.high = len(self.ready) // self.active, -(-len(self.ready) // self.active)
        self.by_owner: dict[str, list[str]] = {}
        for shard in sorted(self.ready):
            self.by_owner.setdefault(self.lease_owners.get(shard) or "", []).append(shard)
        self.unowned = self.by_owner.pop("", [])


def plan(state: Snapshot, moves: int) -> list[tuple[str, str, str]]:
    """(kind, shard_id, donor) of each move, in order.

    Below the low share, unowned shards come first; then shards of the owner with most,
    as long as that keeps more than the low share; an owner with nothing eligible is passed
    over for good.  From the low to the high share only unowned shards are taken.
    """
    out: list[tuple[str, str, str]] = []
    free = [s for s in state.unowned if s not in state.blocked]
    held = {o: list(s) for o, s in state.by_owner.items()}
    count = len(held.pop(state.self_owner, []))
    while count < state.high and len(out) < moves:
        if free:
            out.append((ACQUIRE, free.pop(0), ""))
        elif count < state.low:
            move = None
            while move is None:
                rich = [o for o, s in held.items() if len(s) > state.low]
                if not rich:
                    return out
                donor = min(rich, key=lambda o: (-len(held[o]), o))
                shard = next((s for s in held[donor] if s not in state.blocked), None)
                if shard is None:
                    del held[donor]
                else:
                    held[donor].remove(shard)
                    move = (CLAIM, shard, donor)
            out.append(move)
        else:
            break
        count += 1
    return out


def rebalance(spark, state: Snapshot, moves: int, cooling: set[str] = frozenset(), running: set[str] = frozenset()) -> DataFrame:
    """action_no, kind, shard_id and donor of one pass: the plan, then shards to shed with the moves left.

    Shedding is judged by the state before the plan.
    """
    if not state.ready:
        actions = []
    else:
        actions = plan(state, moves)
        mine = state.by_owner.get(state.self_owner, [])
        moved = {a[1] for a in actions}
        keep = [s for s in mine if s not in cooling and s not in moved and s in running]
        extra = min(len(mine) - state.high, moves - len(actions))
        actions = actions + [(SHED, s, "") for s in keep[: max(0, extra)]]
    rows = [(i, *a) for i, a in enumerate(actions)]
    return spark.createDataFrame(rows, "action_no int, kind string, shard_id string, donor string")


EXECUTED = "action_no int, kind string, shard_id string, donor string, result string"


def rebalance_pass(spark, state: Snapshot, leases: DataFrame, moves: int, now: datetime, ttl_ms: int, cooldown_s: float, cooling: set[str] = frozenset(), running: set[str] = frozenset()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass with its effects: what became of each action, the leases after it, and until when moved shards cool down.

    The plan is made from ``state``; ``leases`` (shard_id, owner, expires_at) are as they
    are when it is carried out.  An unowned shard is acquired and a donor's claimed by the
    laws of leases; a lost race is a skip, not an error, and costs no move.  With the moves
    left, own shards above the high share of ``state`` are released, which neither cool down
    nor were just moved.  Folded on the driver over one row per lease of a stream.
    """
    held = {r.shard_id: (r.owner, r.expires_at) for r in leases.select("shard_id", "owner", F.col("expires_at").cast("timestamp").alias("expires_at")).collect()}
    me, ttl, at = state.self_owner, timedelta(milliseconds=ttl_ms), now.astimezone().replace(tzinfo=None)  # as Spark's rows have it
    results, moved = [], []

    def act(kind: str, shard: str, donor: str, op: str) -> None:
        entry, ok = lease_step(held.get(shard), op, me, donor, at, ttl)
        held.pop(shard, None)
        if entry is not None:
            held[shard] = entry
        moved.extend([shard] * ok)
        results.append((len(results), kind, shard, donor, "moved" if ok else "skipped"))

    for kind, shard, donor in plan(state, moves) if state.ready else []:
        act(kind, shard, donor, {ACQUIRE: "acquire", CLAIM: "claim"}[kind])
    mine = state.by_owner.get(me, [])
    extra = max(0, min(len(mine) - state.high, moves - len(moved)))
    for shard in [s for s in mine if s in running and s not in cooling and s not in moved][:extra]:
        act(SHED, shard, "", "release")
    left = spark.createDataFrame([(s, *e) for s, e in sorted(held.items())], "shard_id string, owner string, expires_at timestamp")
    until = spark.createDataFrame([(s, at + timedelta(seconds=cooldown_s)) for s in moved], "shard_id string, until timestamp")
    return spark.createDataFrame(results, EXECUTED), left, until


def next_pass(minimum: float, jitter: float, share) -> Column:
    """Seconds to the next pass; ``share`` is a column from 0 to 1, such as F.rand()."""
    return F.lit(minimum) + F.lit(jitter) * share


def snapshot_of(ready: DataFrame, leases: DataFrame, workers: DataFrame, self_owner: str, blocked: set[str] = frozenset()) -> Snapshot:
    """Gathers the planner's state: one row per ready shard and worker."""
    return Snapshot([r[0] for r in ready.select("shard_id").collect()], {r.shard_id: r.owner for r in leases.select("shard_id", "owner").collect()}, [r[0] for r in workers.select("owner").collect()], self_owner, set(blocked))
