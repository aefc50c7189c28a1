"""The engine: a snapshot of tables, disguises applied to it, and reveals. A failure leaves the snapshot as it was."""

from __future__ import annotations

import itertools
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import disguise as D
from cloakwork.operators import reveal as R
from cloakwork.operators.speaksfor import durable, pseudoprincipals
from cloakwork.sources.catalog import Decor, Generator, Modify, Remove, TableInfo


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], info: dict[str, TableInfo], generator: Generator):
        durable(spark)
        self.spark, self.tables, self.info, self.generator = spark, dict(tables), info, generator
        self.principal, self.id_col = generator.table, generator.id_col
        self.seq = itertools.count(1)
        self.dids = itertools.count(1)
        self.diffs = spark.createDataFrame([], f"did string, seq long, {D.DIFF}")
        self.edges = spark.createDataFrame([], f"did string, {D.EDGE}")
        self.updates: list[tuple[int, str, Callable[[DataFrame], DataFrame]]] = []

    def record_update(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """A later change of a table's values or schema; reveals replay it on the rows that were away."""
        self.updates.append((next(self.seq), table, change))
        self.tables[table] = change(self.tables[table])

    def updates_since(self, seq: int, table: str) -> list[Callable[[DataFrame], DataFrame]]:
        return [f for s, t, f in self.updates if s > seq and t == table]

    def apply(self, spec: dict[str, list], user=None) -> str:
        """All removes, then for each table its modifies and its decors, then removes of principals; returns the disguise's id."""
        did = f"d{next(self.dids)}"
        # pseudonyms are digests under a random seed: without it nobody can recompute them from owners and row ids
        seed = secrets.token_hex(16)
        tables, diffs, edges = dict(self.tables), [], []
        valid = pseudoprincipals(self.edges, user) if user is not None else None

        def take(table: str, got: D.Result) -> None:
            # diffs and edges are cut from their lineage: later phases read them often
            diffs.append(got.diffs.select(F.lit(did).alias("did"), F.lit(next(self.seq)).cast("long").alias("seq"), *[c for c in got.diffs.columns]).checkpoint())
            tables[table] = got.table.checkpoint()
            if got.edges is not None:
                edges.append(got.edges.select(F.lit(did).alias("did"), "old_uid", "new_uid").checkpoint())
                tables[self.principal] = tables[self.principal].unionByName(got.principals).checkpoint()

        every = [(t, x) for t, xs in sorted(spec.items()) for x in xs]
        for t, x in every:
            if isinstance(x, Remove) and t != self.principal:
                own = self.info[t]
                if len(own.owner_fks) > 1:
                    gone = self._uids(user, valid)
                    take(t, D.remove_shared(tables, own, x, self.generator, seed, gone))
                else:
                    take(t, D.remove(tables, own, x, user, valid=valid))
        for t, x in every:
            if isinstance(x, Modify):
                take(t, D.modify(tables, self.info[t], x, seed, user, valid if self.info[t].owner_fks else None))
        for t, x in every:
            if isinstance(x, Decor):
                take(t, D.decorrelate(tables, self.info[t], x, self.generator, seed, user, valid))
        for t, x in every:
            if isinstance(x, Remove) and t == self.principal:
                take(t, D.remove(tables, self.info[t], x, user, self.principal, valid))
        self.tables = tables
        for d in diffs:
            self.diffs = self.diffs.unionByName(d)
        for e in edges:
            self.edges = self.edges.unionByName(e)
        return did

    def _uids(self, user, valid):
        if user is not None:
            return valid
        return self.tables[self.principal].where(F.col(self.id_col) < D.PP_BASE).select(F.col(self.id_col).cast("string").alias("uid"))

    def reveal(self, did: str, user=None, mode: str = "restore", allow_partial: bool = True) -> None:
        """Undo a disguise, for all or for one user's diffs: principals, then tables by their references, then pseudoprincipals.

        Rows whose references are missing make the whole table's reveal void; its diffs stay for a later one. Updates recorded since are replayed
        on the diffs' images first.
        """
        mine = self.diffs.where(F.col("did") == did)
        if user is not None:
            mine = mine.join(pseudoprincipals(self.edges, user), "uid", "left_semi")
        tables = dict(self.tables)
        first = mine.agg(F.min("seq")).first()[0]
        if first is None:
            return
        order = R.order_of_tables(self.info)
        order.sort(key=lambda t: t != self.principal)
        void: list[str] = []
        gone_pps = mine.where("typ = 'NEW_PP'").select(F.col("new_uid").alias("uid")).distinct()
        for t in order:
            own = mine.where((F.col("tbl") == t) & F.col("typ").isin("REMOVE", "REMOVE_PRINCIPAL", "MODIFY", "DECOR"))
            if mode == "retain":
                own = own.where("typ <> 'DECOR'")
            if own.isEmpty():
                continue
            own = self._replayed(own, t, first)
            after = R.reveal_rows(tables[t], R.collapse(own), self.info[t], allow_partial).checkpoint()
            back = after.join(tables[t].select(*self.info[t].id_cols), list(self.info[t].id_cols), "left_anti")
            if R.orphans(back, self.info[t], tables | {t: after}).isEmpty():
                tables[t] = after
            else:
                void.append(t)
        tables = R.reveal_pseudoprincipals(tables, self.info, self.principal, self.id_col, self.edges, gone_pps, mode)
        self.tables = {t: df.checkpoint() for t, df in tables.items()}
        # the diffs of void tables stay: a later reveal may find their references back
        done = mine.where(~F.col("tbl").isin(void)) if void else mine
        done = done.select("did", "seq", F.to_json("ids").alias("k"), "uid").distinct()
        self.diffs = self.diffs.withColumn("k", F.to_json("ids")).join(done, ["did", "seq", "k", "uid"], "left_anti").drop("k").checkpoint()
        if mode != "retain":
            self.edges = self.edges.join(gone_pps.select(F.col("uid").alias("new_uid")), "new_uid", "left_anti").select("did", "old_uid", "new_uid").checkpoint()

    def _replayed(self, own: DataFrame, table: str, since: int) -> DataFrame:
        """Diffs whose images went through the updates recorded since; columns that an update adds or drops follow."""
        changes = self.updates_since(since, table)
        if not changes:
            return own
        now = self.tables[table]
        for side in ("old", "new"):
            names = [r.k for r in own.select(F.explode(F.map_keys(side)).alias("k")).distinct().collect()]
            if not names:
                continue
            types = dict(now.dtypes)
            rows = own.where(F.col(side).isNotNull()).select(F.struct(*own.columns).alias("__d"), *[F.element_at(side, c).cast(types.get(c, "string")).alias(c) for c in names])
            for f in changes:
                rows = f(rows)
            image = F.create_map(*[x for c in rows.columns if c != "__d" for x in (F.lit(c), F.col(c).cast("string"))])
            done = rows.select(*[(image if c == side else F.col(f"__d.{c}")).alias(c) for c in own.columns])
            own = done.unionByName(own.where(F.col(side).isNull()))
        return own
