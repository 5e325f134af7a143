"""Named, versioned model store on shared storage.

Layout below ``root`` (a folder every executor sees):

* ``factors/``      Parquet partitioned by ``attempt`` (one folder per save
                    batch); columns ``kind ('user'|'item'), id INT,
                    features ARRAY<FLOAT>, model_name``, each model
                    clustered in few files and sorted, so a name filter skips
                    row groups by their min/max statistics
* ``index/``        append-only Parquet, one row per operation:
                    ``model_name, version, op ('save'|'delete'), created_at,
                    rank, iterations, reg, n_ratings, upload_id, attempt, entry``
* ``commits/``      one small JSON file per operation batch, named by its number:
                    ``seq, entry, batch_key, op``
* ``evaluations/``  append-only Parquet: ``model_name, version, evaluated_at,
                    n, n_unknown, mse``
* ``vacuum/``       JSON lists of merged files that are still to be removed

Every operation handles a *batch* of models in one job. Folders are per save
batch, not per model: many small models do not become many small folders.

A batch becomes visible all at once, by its commit file: factors are written
first (under a fresh ``attempt`` token), then the index rows (under a fresh
``entry`` token), then the commit file number ``last + 1`` is created, which fails
if that number exists. Index rows count only if a commit names their entry, so
whatever dies before leaves no trace. Of two writers that work at the same time one
gets the number; the other reads the store again and writes its index rows with
versions above the winner's (its factor files stay). Versions thus grow per name
with every operation and are never shared; the live version of a name is its
highest-version index row when that row is a save.

A commit carries the caller's ``batch_key``: an operation whose key is committed
already (a replayed micro-batch) changes nothing and returns what the first one did.

``vacuum`` keeps the folder small: it merges old index and commit files and removes
factors that no version within the retention needs.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfactor.functions.names import valid_name
from vecfactor.functions.vectors import dot
from vecfactor.plans.sizing import maybe_broadcast

INDEX_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("rank", T.IntegerType()), T.StructField("iterations", T.IntegerType()),
    T.StructField("reg", T.DoubleType()), T.StructField("n_ratings", T.LongType()),
    T.StructField("upload_id", T.StringType()), T.StructField("attempt", T.StringType()),
    T.StructField("entry", T.StringType())])
FACTOR_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("id", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.FloatType())),
    T.StructField("model_name", T.StringType()), T.StructField("attempt", T.StringType())])
COMMIT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("entry", T.StringType()),
    T.StructField("batch_key", T.StringType()), T.StructField("op", T.StringType())])
EVAL_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("evaluated_at", T.TimestampType()), T.StructField("n", T.LongType()),
    T.StructField("n_unknown", T.LongType()), T.StructField("mse", T.DoubleType())])

RATINGS_PER_FILE = 1_000_000
ROWS_PER_INDEX_FILE = 1_000_000
_MAX_BATCH_BROADCAST = 64 * 1024 * 1024


class InvalidModelName(ValueError):
    pass


class ModelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.index_path = f"{self.root}/index"
        self.factors_path = f"{self.root}/factors"
        self.commits_path = f"{self.root}/commits"
        self.evals_path = f"{self.root}/evaluations"
        self.vacuum_path = f"{self.root}/vacuum"

    # ------------------------------------------------------------------ reads
    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:  # noqa: BLE001 - a store without that table yet
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def commits(self) -> DataFrame:
        """``seq, entry, batch_key, op``: one row per operation batch."""
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).json(self.commits_path)
        except Exception as e:  # noqa: BLE001 - a store without any operation yet
            if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
                return self.spark.createDataFrame([], COMMIT_SCHEMA)
            raise

    def index(self) -> DataFrame:
        """The committed index rows."""
        rows = self._read(self.index_path, INDEX_SCHEMA)
        return rows.join(self.commits().select("entry"), "entry", "left_semi")

    def factors(self) -> DataFrame:
        return self._read(self.factors_path, FACTOR_SCHEMA)

    def evaluations(self) -> DataFrame:
        return self._read(self.evals_path, EVAL_SCHEMA)

    def latest(self) -> DataFrame:
        """Live models: ``model_name, version, created_at, rank, iterations, reg, n_ratings``."""
        last = self.index().groupBy("model_name").agg(
            F.max_by(F.struct(*[c for c in INDEX_SCHEMA.fieldNames() if c != "model_name"]), "version").alias("r"))
        return last.where(F.col("r.op") == "save").select(
            "model_name", "r.version", "r.created_at", "r.rank", "r.iterations", "r.reg", "r.n_ratings",
            "r.upload_id", "r.attempt")

    def features(self, names: list[str] | None = None) -> DataFrame:
        """Long format ``model_name, version, kind, id, features`` of live versions.

        A name list becomes a pushed-down Parquet filter on ``model_name``
        (row groups of other models are skipped); the join with the live
        ``(model_name, attempt)`` rows can prune whole save folders.
        """
        f = self.factors()
        live = self.latest().select("model_name", "version", "attempt")
        if names is not None:
            for n in names:
                self._check_name(n)
            f = f.where(F.col("model_name").isin(names))
            live = live.where(F.col("model_name").isin(names))
        return (f.join(live, ["model_name", "attempt"])
                .select("model_name", "version", "kind", "id", "features"))

    def features_json(self, chunk_rows: int = 4096, decimals: int | None = None) -> DataFrame:
        """Feature documents ``{"userFeatures": {id: [..]}, "productFeatures": {..}}``.

        One document per (model, id block of ``chunk_rows`` ids): the service
        answered with one document per model, which for a large model would be
        one unbounded row; blocks merge back into that document by key union.
        Ids are in ascending order inside a document. With ``decimals`` the
        values are rounded and written in fixed-point notation.
        """
        f = self.features().withColumn("blk", F.floor(F.col("id") / chunk_rows))

        def entries(kind):
            return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", "features"))))
        g = f.groupBy("model_name", "version", "blk").agg(entries("user").alias("u"), entries("item").alias("p"))
        if decimals is None:
            doc = F.to_json(F.struct(F.map_from_entries("u").alias("userFeatures"),
                                     F.map_from_entries("p").alias("productFeatures")))
        else:
            def obj(col):
                return F.array_join(F.transform(col, lambda e: F.concat(
                    F.lit('"'), e["id"].cast("string"), F.lit('": ['),
                    F.array_join(F.transform(e["features"], lambda x: F.format_string(
                        f"%.{decimals}f", F.round(x.cast("double"), decimals))), ", "),
                    F.lit("]"))), ", ")
            doc = F.concat(F.lit('{"userFeatures": {'), obj(F.col("u")), F.lit('}, "productFeatures": {'),
                           obj(F.col("p")), F.lit("}}"))
        return g.select("model_name", "version", "blk", doc.alias("document"))

    # ------------------------------------------------------------------ writes
    @staticmethod
    def _check_name(name: str):
        import re
        if name is None or not re.fullmatch(r"[0-9A-Za-z_-]+", name):
            raise InvalidModelName(repr(name))

    def _check_names(self, names: DataFrame):
        bad = names.where(~valid_name("model_name")).limit(1).collect()
        if bad:
            raise InvalidModelName(repr(bad[0]["model_name"]))

    def _with_versions(self, names: DataFrame) -> DataFrame:
        cur = self.index().groupBy("model_name").agg(F.max("version").alias("_v0"))
        return (names.join(cur, "model_name", "left")
                .withColumn("version", F.coalesce("_v0", F.lit(0)).cast("long") + 1).drop("_v0"))

    # ------------------------------------------------------------------ commits
    def _mark(self, seq: int, entry: str, batch_key: str | None, op: str) -> bool:
        """Create commit number ``seq``; False if it exists (another writer was first)."""
        line = json.dumps({"seq": seq, "entry": entry, "batch_key": batch_key, "op": op}) + "\n"
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.commits_path}/{seq:020d}.json")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Exception as e:  # noqa: BLE001 - only an existing file means a lost race
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(line.encode("utf-8")))
        out.close()
        return True

    def committed(self, batch_key: str | None) -> DataFrame | None:
        """Index rows of the batch committed under that key; None if there is none."""
        if batch_key is None:
            return None
        entry = self.commits().where(F.col("batch_key") == batch_key).select("entry").first()
        # a file merged by a vacuum and not removed yet holds the same rows again
        return None if entry is None else \
            self.index().where(F.col("entry") == entry[0]).dropDuplicates(["model_name", "version"])

    def _publish(self, rows, batch_key: str | None, op: str) -> DataFrame:
        """Write the index rows that ``rows()`` gives and commit them; a writer that loses the
        commit number derives its rows again from the store as it is then."""
        while True:
            done = self.committed(batch_key)
            if done is not None:
                return done
            seq = (self.commits().agg(F.max("seq")).first()[0] or 0) + 1
            entry = uuid.uuid4().hex
            # fixes versions and time for the write and for the caller
            own = rows().withColumn("entry", F.lit(entry)).select(*INDEX_SCHEMA.fieldNames()).checkpoint(eager=True)
            own.write.mode("append").parquet(self.index_path)
            if self._mark(seq, entry, batch_key, op):
                return own

    def save(self, factors: DataFrame, meta: DataFrame, batch_key: str | None = None) -> DataFrame:
        """Store a batch of models; returns their ``model_name, version`` rows.

        ``factors``: ``model_name, kind, id, features``; ``meta``: one row per
        model with ``model_name, rank, iterations, reg, n_ratings`` and maybe
        ``upload_id``.
        """
        done = self.committed(batch_key)
        if done is None:
            self._check_names(meta)
            attempt = uuid.uuid4().hex
            self._write_factors(factors, meta, attempt)
            upload = F.col("upload_id").cast("string") if "upload_id" in meta.columns else F.lit(None).cast("string")
            done = self._publish(lambda: self._with_versions(meta).select(
                "model_name", "version", F.lit("save").alias("op"), F.current_timestamp().alias("created_at"),
                F.col("rank").cast("int"), F.col("iterations").cast("int"), F.col("reg").cast("double"),
                F.col("n_ratings").cast("long"), upload.alias("upload_id"), F.lit(attempt).alias("attempt")),
                batch_key, "save")
        return done.select("model_name", "version")

    def _write_factors(self, factors: DataFrame, meta: DataFrame, attempt: str) -> None:
        size = meta.agg(F.sum(F.octet_length("model_name") + 64).alias("b"), F.max("n_ratings").alias("top")).first()
        keys, _ = maybe_broadcast(meta.select("model_name"), size["b"] or 0, _MAX_BATCH_BROADCAST)
        # a model of many ratings spreads over several files; small ones stay in one
        spread = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-(size["top"] or 0) // RATINGS_PER_FILE))))
        (factors.join(keys, "model_name", "left_semi")
         .select("kind", F.col("id").cast("int"), F.col("features").cast("array<float>"), "model_name",
                 F.lit(attempt).alias("attempt"))
         .repartition("model_name", spread)
         .sortWithinPartitions("model_name", "kind", "id")
         .write.mode("append").partitionBy("attempt").parquet(self.factors_path))

    def delete(self, names: DataFrame, batch_key: str | None = None) -> DataFrame:
        """Tombstone live models; returns ``model_name, deleted`` (False when not live)."""
        self._check_names(names)
        names = names.select("model_name").distinct().checkpoint(eager=True)

        def rows():
            live = self.latest().select("model_name")
            nothing = {c: F.lit(None) for c in ("rank", "iterations", "reg", "n_ratings", "upload_id", "attempt")}
            return (self._with_versions(names.join(live, "model_name", "left_semi"))
                    .select("model_name", "version", F.lit("delete").alias("op"),
                            F.current_timestamp().alias("created_at"),
                            *[v.cast(INDEX_SCHEMA[c].dataType).alias(c) for c, v in nothing.items()]))
        gone = self._publish(rows, batch_key, "delete").select("model_name", F.lit(True).alias("_gone"))
        return (names.join(gone, "model_name", "left")
                .select("model_name", F.coalesce("_gone", F.lit(False)).alias("deleted")))

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """Score ``model_name, user, item, rating`` against each live model and
        append one evaluation row per model; returns those rows."""
        live = self.latest().select("model_name", "version", "attempt")
        f = self.factors().join(live, ["model_name", "attempt"])
        uf = f.where(F.col("kind") == "user").select("model_name", "version", F.col("id").alias("user"),
                                                     F.col("features").alias("uf"))
        itf = f.where(F.col("kind") == "item").select("model_name", "version", F.col("id").alias("item"),
                                                      F.col("features").alias("itf"))
        j = (pairs.join(live.drop("attempt"), "model_name")
             .join(uf, ["model_name", "version", "user"], "left")
             .join(itf, ["model_name", "version", "item"], "left"))
        known = F.col("uf").isNotNull() & F.col("itf").isNotNull()
        err = (F.col("rating").cast("double") - dot("uf", "itf")) ** 2
        rows = (j.groupBy("model_name", "version")
                .agg(F.count(F.when(known, 1)).alias("n"), F.count(F.when(~known, 1)).alias("n_unknown"),
                     F.avg(F.when(known, err)).alias("mse"))
                .select("model_name", "version", F.current_timestamp().alias("evaluated_at"),
                        "n", "n_unknown", "mse")
                .checkpoint(eager=True))
        rows.select(*EVAL_SCHEMA.fieldNames()).write.mode("append").parquet(self.evals_path)
        return rows

    def latest_evaluations(self) -> DataFrame:
        """Latest evaluation of every live model."""
        live = self.latest().select("model_name", "version")
        last = self.evaluations().join(live, ["model_name", "version"]).groupBy("model_name", "version").agg(
            F.max_by(F.struct("evaluated_at", "n", "n_unknown", "mse"), "evaluated_at").alias("e"))
        return last.select("model_name", "version", "e.*")


    # ------------------------------------------------------------------ vacuum
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> dict[str, int]:
        """Files or folders directly below the path, with their times in ms."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return {}
        return {str(x.getPath()): x.getModificationTime() for x in fs.listStatus(p)
                if not x.getPath().getName().startswith(("_", "."))}

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)  # already gone: no effect

    def vacuum(self, retention: float = 7 * 24 * 3600.0) -> dict[str, int]:
        """Bound the store's files; what readers see does not change.

        ``retention`` (seconds) must exceed the longest save, read and gap between a writer's
        look at the store and its commit. A version is kept while it was the live one at any
        time within the retention; deletions are kept like versions, so numbers keep growing.

        * Factor folders that no kept version names, and that are older than the retention,
          are removed: replaced and deleted models, lost races, saves that died.
        * Index and commit files older than the retention are merged into few files, without
          the index rows that are not kept. Commits with a batch key are all kept, so a replay
          has no effect however late it comes (it then returns the rows that are kept). The
          merged files are removed by the first vacuum that comes a retention later: until
          then rows stand twice, which no read minds. A vacuum that dies can be run again.

        Folders and files are listed on the driver (one a save batch, as Spark lists them to
        read the store); rows stay in Spark. Returns the numbers of removed ``folders`` and
        ``files`` and of ``merged`` files.
        """
        now = time.time()
        cutoff = int((now - retention) * 1000)
        done = {"folders": 0, "files": 0, "merged": 0}
        for marker, at in self._list(self.vacuum_path).items():
            if at < cutoff:
                for row in self.spark.read.schema("file string").json(marker).toLocalIterator():
                    self._remove(row["file"])
                    done["files"] += 1
                self._remove(marker)
        waiting = set()
        for marker in self._list(self.vacuum_path):
            waiting.update(r["file"] for r in self.spark.read.schema("file string").json(marker).toLocalIterator())
        # taken before the rows are read: what comes later is not touched
        old = {kind: [f for f, at in self._list(path).items() if at < cutoff and f not in waiting]
               for kind, path in (("index", self.index_path), ("commits", self.commits_path))}
        folders = {f: at for f, at in self._list(self.factors_path).items() if at < cutoff}

        index = self.index()
        settled = F.col("created_at") < F.timestamp_millis(F.lit(cutoff))
        base = index.where(settled).groupBy("model_name").agg(F.max("version").alias("_base"))
        kept = index.join(base, "model_name", "left").where(
            F.col("_base").isNull() | (F.col("version") >= F.col("_base")))
        kept = kept.select(*INDEX_SCHEMA.fieldNames()).dropDuplicates(["model_name", "version"]).checkpoint(eager=True)

        named = {r["attempt"] for r in kept.where("attempt IS NOT NULL").select("attempt").distinct().toLocalIterator()}
        # rows that are committed at this moment name their folders, those of a save under way are young
        for folder in folders:
            if folder.rsplit("=", 1)[-1] not in named and all(t < cutoff for t in self._list(folder).values()):
                self._remove(folder)
                done["folders"] += 1

        merged = []
        if len(old["index"]) > 1:
            rows = self.spark.read.schema(INDEX_SCHEMA).parquet(*old["index"])
            rows = kept.join(rows.select("model_name", "version", "entry").distinct(),
                             ["model_name", "version", "entry"], "left_semi").checkpoint(eager=True)
            files = -(-rows.count() // ROWS_PER_INDEX_FILE)
            if files:
                rows.select(*INDEX_SCHEMA.fieldNames()).repartition(files).write.mode("append").parquet(self.index_path)
            merged += old["index"]
        if len(old["commits"]) > 2:  # a merged file and the last number
            rows = self.spark.read.schema(COMMIT_SCHEMA).json(old["commits"]).dropDuplicates(["seq"])
            top = self.commits().agg(F.max("seq")).first()[0]
            needed = kept.select("entry").distinct().withColumn("_kept", F.lit(True))
            rows = rows.join(needed, "entry", "left").where(
                F.col("_kept") | F.col("batch_key").isNotNull() | (F.col("seq") == top)).drop("_kept")
            rows.coalesce(1).write.mode("append").json(self.commits_path)
            # the file of the last number stays, so that no writer can take it again
            merged += [f for f in old["commits"] if not f.endswith(f"/{top:020d}.json")]
        if merged:
            self.spark.createDataFrame([(f,) for f in merged], "file string").coalesce(1) \
                .write.json(f"{self.vacuum_path}/{uuid.uuid4().hex}")
            done["merged"] = len(merged)
        return done


def train_and_store(store: ModelStore, parsed: DataFrame, seed: int = 42, batch_key: str | None = None) -> DataFrame:
    """Train and store the models of a batch of parsed uploads (M2, M3, S11).

    An upload without a name gets a generated 32-character name (M8). For a named
    model the latest accepted upload wins and is a full retrain on that upload
    alone: the latest is the greatest by ``arrived_at`` (if the uploads carry it),
    then ``upload_id``, then a hash of its content, so there is exactly one. The
    models are fit together (:mod:`vecfactor.operators.batch_als`); none depends
    on the others. With a ``batch_key`` generated names derive from (key,
    upload_id), and a key that is committed already trains and stores nothing.
    Returns ``upload_id, model_name, version`` of the uploads that produced a
    model, so a caller learns generated names.
    """
    from vecfactor.functions.names import generated_names
    from vecfactor.operators import batch_als
    from vecfactor.sources.payloads import accepted, flatten_ratings
    done = store.committed(batch_key)
    if done is not None:
        return done.select("upload_id", "model_name", "version")
    acc = accepted(parsed).withColumn(
        "model_name", F.coalesce(F.col("model_name"), generated_names("upload_id", nonce=batch_key)))
    order = [c for c in ("arrived_at",) if c in parsed.columns]
    acc = acc.withColumn("_at", F.struct(*order, "upload_id", F.xxhash64("rank", "iterations", "reg", "ratings")))
    last = acc.groupBy(F.col("model_name").alias("_model")).agg(F.max("_at").alias("_last"))
    # the chosen uploads feed several reads below: materialise them once; equal rows are one upload
    chosen = (acc.join(last, (F.col("model_name") == F.col("_model")) & F.col("_at").eqNullSafe(F.col("_last")))
              .select(*parsed.columns).dropDuplicates(["model_name"]).checkpoint(eager=True))
    params = chosen.select("upload_id", "model_name", "rank", "iterations", "reg", "n_ratings")
    ratings = flatten_ratings(chosen).drop("upload_id").join(params.drop("n_ratings", "upload_id"), "model_name")
    saved = store.save(batch_als.train_many(ratings, seed), params, batch_key)
    return chosen.select("upload_id", "model_name").join(saved, "model_name")
