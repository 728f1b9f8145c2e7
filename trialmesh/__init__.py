"""trialmesh: Spark jobs for running, scoring and ranking data experiments.

Every public operator takes DataFrames and returns a lazy DataFrame unless its
docstring says otherwise.
"""
