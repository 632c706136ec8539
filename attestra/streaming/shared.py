"""Where streams keep their state: the folder that driver and executors share."""

from ..operators.tables import work_folder

__all__ = ["work_folder"]
