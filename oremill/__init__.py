"""oremill: data mining on Spark DataFrames.

Market-basket mining, co-occurrence graphs and their communities, stream
summaries, and clustering with compressed cluster summaries.  Every operator
takes DataFrames and returns DataFrames.
"""

from oremill.session import local_session

__all__ = ["local_session"]
