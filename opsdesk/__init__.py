"""opsdesk — support-operations analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame (or a dict of them); nothing
is collected to the driver.  ``as_of`` is always an explicit parameter.
"""

from opsdesk.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
