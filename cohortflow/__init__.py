"""cohortflow: Spark-native panel analytics (one row per entity and day).

Every operator takes and returns a DataFrame and is written with built-in
``pyspark.sql.functions`` so Catalyst can prune, push down and fuse it.
"""

from cohortflow.config import PanelConfig
from cohortflow.session import ensure_session_conf, get_session, checkpoint_dir

__all__ = ["PanelConfig", "ensure_session_conf", "get_session", "checkpoint_dir"]
