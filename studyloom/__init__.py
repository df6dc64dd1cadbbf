"""Learning analytics and course-corpus preparation as Spark jobs.

Every operator takes DataFrames and returns a DataFrame. Nothing here runs an
action unless its docstring says so (writers and the size check of the nearest
neighbour search do).
"""

__version__ = "0.1.0"
