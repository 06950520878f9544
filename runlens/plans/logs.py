"""The logs of a root folder as tables, read from CSV or from a columnar store."""

from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import functions as F

from runlens.functions.paths import config_label, experiment_name, tag_from_name
from runlens.operators.latency import latency_bins
from runlens.sources import logs
from runlens.sources.buckets import bucketed
from runlens.sources.incremental import followed, synced
from runlens.sources.index import experiment_index
from runlens.sources.store import exists, materialize, settle


#: The time that a stored log is sorted by inside an experiment, so that ranges of it read little.
_TIMES = {
    "transactions": "sent_at",
    "deadlocks": "time",
    "txn_timestamps": "server_time",
    "measurements": "time",
    "client_events": "time",
    "server_events": "time",
    "link_latency": "send_time",
    "resolver": "time",
}


class RunLogs:
    """All logs below ``root``; each table covers all experiments, keyed by ``prefix``.

    With ``store`` a table is converted to Parquet, laid out by experiment and time, and read from
    there: studies then read only the columns, experiments and ranges of time that they use. ``refresh`` says what a store does
    when a table is first used: ``"changed"`` (default) lists the logs and rebuilds the experiments
    that are new or whose files changed, ``"all"`` rebuilds everything, ``"never"`` takes the store
    as it is. ``tags`` maps a column
    name to the pattern of a number in the experiment names. ``options`` maps the name of a table
    to more arguments of its reader, for logs of an old layout: ``{"deadlocks": {"region_col":
    "replica"}, "measurements": {"legacy": True}, "resolver": {"server": "1-0"}}``.
    """

    def __init__(
        self,
        spark,
        root,
        store=None,
        experiment="*",
        tags=None,
        plain_names=False,
        options=None,
        refresh="changed",
    ):
        if refresh not in ("changed", "all", "never"):
            raise ValueError("refresh must be 'changed', 'all' or 'never'")
        self.refresh = refresh
        self.spark = spark
        self.root = root
        self.store = store
        self.experiment = experiment
        self.tags = tags or {}
        self.plain_names = plain_names
        self.options = options or {}
        #: How many parts of a path name an experiment below the root.
        self.depth = experiment.strip("/").count("/") + 1

    def _table(self, name, read):
        def build(prefixes=None):
            chosen = self.experiment if prefixes is None else [self._name(p) for p in prefixes]
            return read(self.spark, self.root, chosen, **self.options.get(name, {}))

        if self.store is None:
            return build()
        path = f"{self.store}/{name}"
        if self.refresh == "never":
            return materialize(self.spark, path, build, partition_by="prefix")
        side, file = logs.FILES[name]
        sources = logs.log_paths(self.root, self.experiment, side, "*", file)
        return synced(self.spark, path, sources, build, self.refresh == "all", _TIMES.get(name))

    def _name(self, prefix):
        """The name below the root of an experiment's path, which Spark gives as a URI."""
        return "/".join(unquote(part) for part in prefix.rstrip("/").split("/")[-self.depth :])

    def _index(self):
        """The index, rebuilt as a whole when a metadata file changed: it is small."""

        def build():
            return experiment_index(
                self.spark, self.root, self.experiment, **self.options.get("index", {})
            )

        if self.store is None:
            return settle(build(), "index")
        path = f"{self.store}/index"
        if self.refresh == "never":
            return materialize(self.spark, path, build)
        sources = [
            logs.log_paths(self.root, self.experiment, side, "*", "metadata.csv")
            for side in ("client", "server")
        ]
        return followed(self.spark, path, sources, build, self.refresh == "all")

    @cached_property
    def index(self):
        """One row per experiment, with the tags; ``plain_names`` drops ``.conf``.

        It is a stored table in any case, so that its real size is known to the joins.
        """
        index = self._index()
        for name, pattern in self.tags.items():
            index = tag_from_name(index, name, pattern, depth=self.depth)
        return config_label(index) if self.plain_names else index

    def by_transaction(self, name, buckets=None):
        """A client log (``transactions``, ``client_events``) dealt into buckets by transaction.

        Joins of two such tables on (prefix, txn_id), and the sums of events before them, move no
        rows. Needs a ``store``; ``buckets`` (``spark.sql.shuffle.partitions`` by default) must be
        the same for both, about 200 MB each. A changed log is dealt anew as a whole: from its table
        in the store, if there is one, which follows the logs by experiment, else from the logs.
        """
        if self.store is None:
            raise ValueError("a layout by transaction needs a store")
        buckets = int(buckets or self.spark.conf.get("spark.sql.shuffle.partitions"))
        side, file = logs.FILES[name]
        path = f"{self.store}/{name}_by_transaction"

        def keep(spark, path, build, refresh=False):
            return bucketed(spark, path, build, ["prefix", "txn_id"], buckets, refresh)

        def build():
            if exists(self.spark, f"{self.store}/{name}/_schema/_SUCCESS"):
                return getattr(self, name)
            read, options = getattr(logs, f"read_{name}"), self.options.get(name, {})
            rows = read(self.spark, self.root, self.experiment, **options)
            return rows.select(*[c for c in rows.columns if c != "prefix"], "prefix")

        if self.refresh == "never":
            return keep(self.spark, path, build)
        sources = logs.log_paths(self.root, self.experiment, side, "*", file)
        return followed(self.spark, path, sources, build, self.refresh == "all", keep)

    @cached_property
    def transactions(self):
        return self._table("transactions", logs.read_transactions)

    @cached_property
    def latency_bins(self):
        """Stored counts of latencies per bin, experiment and machine; None without a store.

        They follow the logs as tables do: the counts of new or changed experiments alone are made.
        """
        if self.store is None:
            return None
        path, (side, file) = f"{self.store}/latency_bins", logs.FILES["transactions"]

        def build(prefixes=None):
            rows = self.transactions
            if prefixes is not None:
                rows = rows.where(F.col("prefix").isin(prefixes))
            return latency_bins(rows)

        if self.refresh == "never":
            return materialize(self.spark, path, build, partition_by="prefix")
        sources = logs.log_paths(self.root, self.experiment, side, "*", file)
        return synced(self.spark, path, sources, build, self.refresh == "all")

    @cached_property
    def summary(self):
        return self._table("summary", logs.read_summary)

    @cached_property
    def deadlocks(self):
        return self._table("deadlocks", logs.read_deadlocks)

    @cached_property
    def txn_timestamps(self):
        return self._table("txn_timestamps", logs.read_txn_timestamps)

    @cached_property
    def measurements(self):
        return self._table("measurements", logs.read_measurements)

    @cached_property
    def client_events(self):
        return self._table("client_events", logs.read_client_events)

    @cached_property
    def server_events(self):
        return self._table("server_events", logs.read_server_events)

    @cached_property
    def link_latency(self):
        return self._table("link_latency", logs.read_link_latency)

    @cached_property
    def resolver(self):
        return self._table("resolver", logs.read_resolver)

    def with_experiment(self, df):
        """``df`` with the name of each row's ``experiment``, which does not hold the root."""
        return df.withColumn("experiment", experiment_name("prefix", self.depth))

    def experiments(self, **settings):
        """The experiments with the given metadata; a list means any of its values."""
        index = self.index
        for name, value in settings.items():
            values = value if isinstance(value, (list, tuple)) else [value]
            index = index.where(F.col(name).isin(list(values)))
        return index
