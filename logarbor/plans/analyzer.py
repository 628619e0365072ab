"""The analyzer: one object that reads a log and answers the reports.

    analyzer = LogAnalyzer.from_paths(spark, ["/logs/syslog", "/logs/syslog.1.gz"], AnalyzerOptions(...))
    analyzer = LogAnalyzer.from_latest(spark, "/var/log")          # the newest log of the folder
    analyzer.tree_rows()          # date -> service -> first N entries -> overflow
    analyzer.summary()            # totals, services, date range, days, errors
    analyzer.find_errors("sshd")  # errors in time order
    analyzer.filter_logs(service_pattern="ssh.*", level="ERROR")
    analyzer.export_json(path); analyzer.export_csv(path)
    analyzer.land(path)           # entries as Parquet; then, for many reports:
    LogAnalyzer.from_landed(spark, path, options)

Nothing is cached behind the caller's back: a report on a log reads the columns and
rows it needs. For several reports, land once and read the landed entries, where day
windows prune partitions and every report reads only its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarbor.functions.formats import BY_NAME
from logarbor.operators import clusters, quality, search, sketches, summary, tree
from logarbor.operators.parse import classify, parse
from logarbor.operators.plugins import Plugin, registered
from logarbor.options import AnalyzerOptions
from logarbor.sinks import landing, writers
from logarbor.sources.discovery import latest_log, rotation_set
from logarbor.sources.files import read_lines

REPORT_ROWS = 10  # rows of a plugin's result shown in the JSON document and the summary; all rows go beside it


class LogAnalyzer:
    """``plugins``: name -> plugin for this analyzer; the registered ones when not given."""

    def __init__(self, lines: DataFrame | None, options: AnalyzerOptions | None = None, source: str | None = None,
                 plugins: dict[str, Plugin] | None = None, landed: DataFrame | None = None):
        self.options = options or AnalyzerOptions()
        self.lines = lines
        self.source = source
        self.plugins = registered() if plugins is None else dict(plugins)
        self._landed = landed
        self._beside: tuple[SparkSession, str] | None = None

    @classmethod
    def from_paths(cls, spark: SparkSession, paths, options: AnalyzerOptions | None = None,
                   partitions: int | None = None, **kw) -> "LogAnalyzer":
        options = options or AnalyzerOptions()
        lines = read_lines(spark, paths, options.decode, partitions)
        return cls(lines, options, source=paths if isinstance(paths, str) else ",".join(paths), **kw)

    @classmethod
    def from_latest(cls, spark: SparkSession, base_dir: str, options: AnalyzerOptions | None = None,
                    **kw) -> "LogAnalyzer":
        """The most recently changed log of a folder."""
        options = options or AnalyzerOptions()
        path = latest_log(spark, base_dir, options.as_of)
        if path is None:
            raise FileNotFoundError(f"no log found under {base_dir}")
        return cls.from_paths(spark, path, options, **kw)

    @classmethod
    def from_rotations(cls, spark: SparkSession, base_dir: str, name: str, options: AnalyzerOptions | None = None,
                       **kw) -> "LogAnalyzer":
        """One log with all its rotations."""
        options = options or AnalyzerOptions()
        paths = rotation_set(spark, base_dir, name, options.as_of)
        if not paths:
            raise FileNotFoundError(f"no {name} found under {base_dir}")
        return cls.from_paths(spark, paths, options, **kw)

    @classmethod
    def from_landed(cls, spark: SparkSession, path: str, options: AnalyzerOptions | None = None,
                    **kw) -> "LogAnalyzer":
        """Entries written by ``land``, within the day window of the options."""
        options = options or AnalyzerOptions()
        out = cls(None, options, source=path, landed=writers.read_landed(spark, path, options), **kw)
        out._beside = (spark, path)
        return out

    # ---- data -----------------------------------------------------------------
    @property
    def entries(self) -> DataFrame:
        return parse(self.lines, self.options) if self._landed is None else self._landed

    @property
    def cells(self) -> DataFrame:
        """Entries and errors by day, hour, service and level; of a landed log from the totals beside the entries."""
        kept = landing.landed_cells(*self._beside, self.options) if self._beside else None
        return summary.cell_counts(self.entries) if kept is None else kept

    @property
    def nodes(self) -> DataFrame:
        return summary.nodes_of(self.cells) if self._beside else summary.node_counts(self.entries)

    def classified(self) -> DataFrame:
        if self.lines is None:
            raise ValueError("landed entries keep no unparsed lines: this needs the log itself")
        return classify(self.lines, self.options)

    # ---- reports --------------------------------------------------------------
    def tree_rows(self) -> DataFrame:
        return tree.report_order(tree.tree_rows(self.entries, self.options, self.nodes))

    def tree_nodes(self) -> DataFrame:
        return tree.tree_nodes(self.entries, self.options.max_lines_per_service, self.nodes)

    def summary(self) -> DataFrame:
        return summary.summary(self.entries, self.nodes)

    def service_counts(self) -> DataFrame:
        return summary.ordered(self._service_counts())

    def _service_counts(self) -> DataFrame:
        return summary.service_counts(self.entries, self.nodes if self._beside else None)

    def top_services(self, k: int = 5) -> DataFrame:
        return summary.top_k(self._service_counts(), k)

    def top_services_text(self, k: int = 5) -> DataFrame:
        """The summary line 'svc (1,234), other (99)' of the k most frequent services."""
        return summary.top_services_text(self.top_services(k))

    def level_distribution(self) -> DataFrame:
        return summary.ordered(summary.levels_of(self.cells) if self._beside else summary.level_distribution(self.entries))

    def hourly_distribution(self) -> DataFrame:
        return summary.ordered(summary.hours_of(self.cells) if self._beside else summary.hourly_distribution(self.entries))

    def error_clusters(self, k: int | None = 10) -> DataFrame:
        return clusters.error_clusters(self.entries, k)

    def error_clusters_by_service(self) -> DataFrame:
        return clusters.error_clusters_by_service(self.entries)

    def distinct_estimates(self) -> DataFrame:
        """(what, estimate) of a log landed with day summaries: distinct services, hosts, messages, error patterns."""
        return sketches.distinct_estimates(self._summaries("_sketches", sketches.day_sketches))

    def top_patterns(self, k: int = 10) -> DataFrame:
        """(pattern, n, n_max, sure) of a log landed with day summaries; ``error_clusters`` is the exact report."""
        return sketches.top_patterns(self._summaries("_patterns", sketches.frequent_patterns), k)

    def _summaries(self, name: str, of) -> DataFrame:
        if self._beside is None:
            raise ValueError("day summaries are kept beside landed entries: land(patterns=...), then from_landed")
        return landing.landed_summaries(*self._beside, self.options, name, of)

    def find_errors(self, service: str | None = None) -> DataFrame:
        return search.find_errors(self.entries, service, stored=self._landed is not None)

    def filter_logs(self, service_pattern: str | None = None, level: str | None = None,
                    message_contains: str | None = None) -> DataFrame:
        return search.filter_logs(self.entries, service_pattern, level, message_contains,
                                  stored=self._landed is not None)

    def last_errors(self, service: str | None = None, k: int = 10) -> DataFrame:
        return search.error_hits(self.entries, service, k)

    def last_matches(self, k: int = 20, **criteria) -> DataFrame:
        return search.match_hits(search.matching(self.entries, **criteria), k)

    def parse_quality(self) -> DataFrame:
        """Of a landed log: as measured while it was landed, over all its lines."""
        kept = landing.landed_formats(*self._beside) if self._beside else None
        return quality.parse_quality(self.classified()) if kept is None else quality.quality_of_counts(kept)

    def format_counts(self) -> DataFrame:
        kept = landing.landed_formats(*self._beside) if self._beside else None
        return quality.format_counts(self.classified()) if kept is None else kept

    def format_profile(self) -> DataFrame:
        return quality.format_profile(self.classified())

    def plugin_results(self) -> dict[str, dict[str, DataFrame]]:
        entries = self.entries
        return {name: plugin(entries) for name, plugin in self.plugins.items()}

    def summary_lines(self) -> DataFrame:
        """The text summary (line_no, text), followed by the first rows of every plugin's results."""
        lines = summary.summary_lines(self.entries)
        for i, (name, results) in enumerate(sorted(self.plugin_results().items()), 1):
            for j, (result, rows) in enumerate(sorted(results.items())):
                at = F.lit(i * 1_000_000 + j * 1_000)
                head = rows.sparkSession.range(1).select(at.cast("bigint").alias("line_no"),
                                                         F.lit(f"  {name} {result}:").alias("text"))
                shown = rows.limit(REPORT_ROWS).select(F.to_json(F.struct(*rows.columns)).alias("json"))
                body = shown.select((at + 1 + F.monotonically_increasing_id()).cast("bigint").alias("line_no"),
                                    F.concat(F.lit("    "), "json").alias("text"))
                lines = lines.unionByName(head).unionByName(body)
        return lines

    # ---- exports ---------------------------------------------------------------
    def parser_info(self) -> dict:
        fmts = self.options.formats
        return {"patterns_loaded": len(fmts), "pattern_types": list(fmts),
                "pattern_descriptions": [BY_NAME[f].description for f in fmts]}

    def json_report(self) -> DataFrame:
        """One-row bounded document: metadata, summary, levels, hours, and the first rows of every plugin's results.

        What grows with the log (services, all plugin rows) is written beside it by ``export_json``.
        """
        o = self.options
        info = self.parser_info()
        cells = summary.materialised(summary.cell_counts(self.entries))

        def pairs(dist: DataFrame, name: str) -> DataFrame:
            return dist.agg(F.sort_array(F.collect_list(F.struct(F.negative("n").alias("_o"), "key", "n")))
                            .alias("_a")).select(F.transform("_a", lambda s: F.struct(
                                s["key"].alias("key"), s["n"].alias("count"))).alias(name))

        summ = summary.nodes_of(cells).agg(
            F.struct(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_entries"),
                F.count_distinct("service").alias("unique_services"),
                F.array(F.date_format(F.min("log_date"), "yyyy-MM-dd"),
                        F.date_format(F.max("log_date"), "yyyy-MM-dd")).alias("date_range"),
                F.count_distinct("log_date").alias("days_with_logs"),
                F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("error_count"),
            ).alias("summary"))
        parts = [pairs(summary.levels_of(cells), "level_stats"), pairs(summary.hours_of(cells), "hourly_distribution")]
        plugins = {}
        for i, (name, results) in enumerate(self.plugin_results().items()):
            for j, (result, rows) in enumerate(results.items()):
                column = f"_p{i}_{j}"
                plugins.setdefault(name, {})[result] = column
                parts.append(rows.limit(REPORT_ROWS).agg(F.collect_list(F.struct(*rows.columns)).alias(column)))
        # every part is a one-row aggregate: joining them on a constant key builds the document
        doc = summ.withColumn("_k", F.lit(1))
        for part in parts:
            doc = doc.join(part.withColumn("_k", F.lit(1)), "_k")
        meta = F.struct(
            F.lit(writers.exported_at()).alias("exported_at"),
            F.lit(self.source).cast("string").alias("log_file"),
            F.lit(o.max_days).alias("analysis_period_days"),
            F.struct(F.lit(info["patterns_loaded"]).alias("patterns_loaded"),
                     F.array(*[F.lit(x) for x in info["pattern_types"]]).alias("pattern_types"),
                     F.array(*[F.lit(x) for x in info["pattern_descriptions"]]).alias("pattern_descriptions"))
            .alias("parser_info"))
        shown = [F.struct(*(F.col(c).alias(result) for result, c in results.items())).alias(name)
                 for name, results in plugins.items()]
        return doc.select(meta.alias("metadata"), "summary", "level_stats", "hourly_distribution",
                          *([F.struct(*shown).alias("plugin_results")] if shown else []))

    def export_json(self, path: str) -> None:
        tables = {"service_stats": summary.service_counts(self.entries)}
        tables |= {f"plugins/{name}/{result}": rows for name, results in self.plugin_results().items()
                   for result, rows in results.items()}
        writers.write_json_report(self.json_report(), tables, path)

    def export_csv(self, path: str, ordered: bool = True) -> None:
        writers.write_csv(self.entries, path, ordered=ordered)

    def land(self, path: str, mode: str = "overwrite", batch: str | None = None, patterns: int | None = None) -> str:
        """Entries, totals and parse quality under ``path``, from one pass over the log; returns the batch's name.

        ``patterns``: keep day summaries as well, with so many error patterns a day.
        """
        if self.lines is None:
            raise ValueError("this log is landed already")
        return landing.land_log(self.lines, self.options, path, mode, batch, patterns=patterns)
