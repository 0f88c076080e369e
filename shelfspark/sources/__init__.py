"""Readers and writers for catalogue files, corpora, inventories and logs."""

from shelfspark.sources.readers import *  # noqa: F401,F403
from shelfspark.sources.sinks import *  # noqa: F401,F403
