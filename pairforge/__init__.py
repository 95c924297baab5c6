"""pairforge: Spark-native preparation and measurement of contrastive (query, positive, negative) data.

"""

from pairforge.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
