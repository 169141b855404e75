"""casebook — clinical-event analytics expressed as Spark DataFrame / SQL plans.

Every public operator is a plain function ``DataFrame(s) -> DataFrame`` built
from built-in ``pyspark.sql.functions``; nothing iterates rows on the driver.
"""

from casebook.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
