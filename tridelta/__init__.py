"""tridelta: keep a Tucker model of a growing sparse three-way table up to
date with Spark DataFrames."""

from .plans.job import start_model, tucker_job
from .plans.update import incremental_update
from .session import local_session

__all__ = ["incremental_update", "tucker_job", "start_model", "local_session"]
