"""Product-catalog preparation, vector encoding and proxy-task evaluation on Spark.

Layers, from the bottom up:

``functions``  column expressions and small per-batch numpy kernels
``sources``    readers, writers and the shared scratch area
``operators``  one DataFrame-to-DataFrame step each
``plans``      whole flows composed from the operators
``streaming``  the row-local flow over files as they arrive
"""

__version__ = "0.1.0"
