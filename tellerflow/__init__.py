"""Conversational-banking analytics as Spark jobs.

``sources``    schemas, scans, sinks, generators, derived views and fixed values
``functions``  column expressions: text cleaning, entities, intents, replies, prompts
``operators``  DataFrame operators: timelines, dialogue, ledger lookups, corpus, chat log
``plans``      the registered queries and their SQL counterparts
``streaming``  the dialogue as a Structured Streaming job
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
