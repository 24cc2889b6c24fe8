"""folioscope: a PySpark-native engine for analytics over technical manuals."""

import os
from pathlib import Path

__version__ = "0.1.0"


def share(spark) -> None:
    """Lets Python workers find this package where the driver found it.

    On a cluster it must be installed or sent along; a folder that is not there is passed over.
    """
    context = getattr(spark, "_sc", None)
    if context is None:
        return
    here = str(Path(__file__).resolve().parent.parent)
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, here) if p)
