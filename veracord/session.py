"""Sessions: where tables come from, which models answer, which optimisations are on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession

from veracord.frame import SemanticFrame
from veracord.models.embedding import HashEmbedder
from veracord.models.language import LanguageModel
from veracord.plans.nodes import Scan
from veracord.plans.rules import Options
from veracord.plans.schema import Row, Schema
from veracord.sources.cache import ResponseCache
from veracord.sources.tables import read_jsonl, read_log


class Session:
    """Entry point. All switches are off at first; ``optimised`` turns them on together."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.options = Options()
        self.model: LanguageModel | None = None
        self.explain = True

    @classmethod
    def optimised(cls, spark: SparkSession | None = None, seed: int = 42, cache: str | None = None) -> Session:
        s = cls(spark).enable_batching().enable_early_stop().enable_fusion().enable_minimal_provenance()
        s = s.enable_relevance_sort().enable_similarity_filter().enable_estimation(seed=seed)
        return s.enable_cache(cache) if cache else s

    # sources

    def read_rows(self, rows: Iterable[Row | tuple], schema: Schema) -> SemanticFrame:
        data = [tuple(getattr(v, "value", v) for v in (r.values if isinstance(r, Row) else r)) for r in rows]
        return self.read_frame(self.spark.createDataFrame(data, schema.struct()), schema.key, schema)

    def read_json(self, path: str, key: tuple[str, ...]) -> SemanticFrame:
        return self.read_frame(read_jsonl(self.spark, path), key)

    def read_parquet(self, path: str, key: tuple[str, ...]) -> SemanticFrame:
        return self.read_frame(self.spark.read.parquet(path), key)

    def read_log(self, path: str) -> SemanticFrame:
        df, schema = read_log(self.spark, path)
        return self.read_frame(df, schema.key, schema)

    def read_frame(self, df: SparkFrame, key: tuple[str, ...], schema: Schema | None = None) -> SemanticFrame:
        return SemanticFrame(self, Scan(df, schema or Schema.of(df.schema, tuple(key))))

    # models

    def register_model(self, model: LanguageModel) -> Session:
        self.model = model
        return self

    def register_embedder(self, embedder: HashEmbedder) -> Session:
        self.options.embedder = embedder
        return self

    def register_planner(self, planner) -> Session:
        """The model that turns a prompt into a retrieval query and keywords."""
        self.options.planner = planner
        return self

    # switches

    def enable_batching(self, batch: int = 32) -> Session:
        self.options.batch = batch
        return self

    def enable_early_stop(self) -> Session:
        self.options.early_stop = True
        return self

    def enable_fusion(self) -> Session:
        self.options.fusion = True
        return self

    def enable_minimal_provenance(self) -> Session:
        self.options.minimal = True
        return self

    def enable_relevance_sort(self) -> Session:
        self.options.relevance = True
        return self.enable_early_stop()

    def enable_similarity_filter(self, threshold: float = 0.15) -> Session:
        if not -1 < threshold < 1:
            raise ValueError("the similarity threshold lies between -1 and 1")
        self.options.similarity = threshold
        return self

    def enable_estimation(self, confidence_level: float = 0.95, relative_error: float = 0.05, seed: int = 42) -> Session:
        if not 0 < confidence_level < 1 or not 0 < relative_error < 1:
            raise ValueError("confidence level and relative error lie between 0 and 1")
        self.options.estimation = (confidence_level, relative_error, seed)
        return self.enable_early_stop()

    def enable_cache(self, path: str) -> Session:
        self.options.cache = path
        return self

    def disable_provenance(self) -> Session:
        """Values only: no companion columns are computed."""
        self.explain = False
        return self

    def allow_nulls(self) -> Session:
        """Aggregates skip null arguments instead of failing."""
        self.options.strict_nulls = False
        return self

    @property
    def response_cache(self) -> ResponseCache | None:
        return ResponseCache(self.options.cache) if self.options.cache else None

    def clear_cache(self) -> None:
        if self.options.cache:
            ResponseCache(self.options.cache).clear(self.spark)
