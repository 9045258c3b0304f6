"""The corpus pipeline: its stages, run(spark, sf_dir) and SQL. The code is in terrascape.llm.pipeline."""

from terrascape.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
