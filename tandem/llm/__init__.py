"""Operations of a training-data pipeline.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.  Every
operator takes and returns DataFrames, selects the columns it needs by name, and treats a
null text as an empty one.  Further columns do not clash with what an operator uses inside;
where one keeps them and adds a column whose name is there already, it raises ValueError.
"""
