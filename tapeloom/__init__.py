"""Panel analytics and backtesting as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame over an
``(entity, date)`` panel; nothing runs until the caller takes an action.
"""
