"""tilewright: matrices, execution traces and corpus data as Spark DataFrames.

Sub-packages
------------
``plans``      matrix handles, the domain planner, hot-key sharding, shared storage
``operators``  matrix operators and data-processing operators
``functions``  cost formulas, block-cyclic maps and numpy tile kernels
``sources``    table readers, trace decoding and CSV sinks
``streaming``  the same trace analytics over Structured Streaming
``queries``    the registered queries and their SQL oracles
"""

__version__ = "0.1.0"
