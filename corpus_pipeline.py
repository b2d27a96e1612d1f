"""The corpus pipeline: STAGES, run(spark, sf_dir) and ORACLE_SQL, which are part of the subpackage llm."""

from fernsql.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
