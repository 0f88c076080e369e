"""Literature-catalogue and paper-corpus analytics as plain Spark functions.

Everything public is either ``Column -> Column`` (``shelfspark.functions``) or
``DataFrame -> DataFrame`` (``operators``, ``sources``, ``plans``,
``streaming``), so it composes with ``df.transform(...)`` and stays one lazy
plan for Catalyst.
"""

__version__ = "0.1.0"
