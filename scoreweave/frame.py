"""ScoreFrame: the operators in one place, each step a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .operators import cells as C
from .operators import derive, impute, multivariate, rank
from .sources import documents, sinks

IMPUTERS = {
    "mean": lambda cells, n: impute.impute_mean(cells),
    "bivariate": lambda cells, n: impute.impute_bivariate(cells, n or 1),
    "consolidated": lambda cells, n: impute.impute_consolidated(cells),
    "multivariate": lambda cells, n: multivariate.impute_multivariate(cells, 1 if n is None else n),
    "multivariate_gd": lambda cells, n: multivariate.impute_multivariate_gd(cells, n or 100),
    "consolidated_gd": lambda cells, n: multivariate.impute_consolidated_gd(cells, n or 10_000),
}


@dataclass(frozen=True)
class ScoreFrame:
    """observations (entity, metric, score, std_dev, source, ord); entities (entity, company, url, release_date, capabilities, ord);
    cells, once merged: (entity, metric, score, std_dev, source, is_known); shown: the entities that filters let pass, all if None."""

    observations: DataFrame
    entities: DataFrame
    cells: DataFrame | None = None
    shown: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ScoreFrame:
        entities, observations = documents.read_models(spark, path)
        return cls(observations, entities)

    def derive(self, requirements: DataFrame, floor_replaces: bool = False) -> ScoreFrame:
        return replace(self, observations=derive.derive_all(self.observations, self.entities, requirements, floor_replaces))

    def merge(self) -> ScoreFrame:
        return replace(self, cells=C.densify(C.merge_cells(self.observations).drop("n")))

    def impute(self, method: str = "bivariate", iterations: int | None = None) -> ScoreFrame:
        cells = self.cells if self.cells is not None else self.merge().cells
        kept = cells.where("is_known").select("entity", "metric", "score", "std_dev", "source", "is_known")
        filled = IMPUTERS[method](cells.drop("source"), iterations).where("not is_known").select(kept.columns)
        return replace(self, cells=kept.unionByName(filled))

    def composite(self, criteria: DataFrame) -> DataFrame:
        """Composites of the entities shown; z-scores are over all entities, whatever filters let pass."""
        out = rank.composite_scores(self.cells, criteria)
        return out if self.shown is None else out.join(self.shown, "entity", "left_semi")

    def filter(self, metric: str | None, value: float | None, below: bool = True) -> ScoreFrame:
        passing = rank.passing(self.cells, metric, value, below)
        return replace(self, shown=passing if self.shown is None else self.shown.join(passing, "entity", "left_semi"))

    def rank(self, criteria: DataFrame) -> DataFrame:
        return rank.ranking(self.composite(criteria))

    def history(self, criteria: DataFrame) -> DataFrame:
        return rank.running_best(self.composite(criteria), self.entities)

    def document(self) -> DataFrame:
        return sinks.nested(self.cells, self.entities)
