"""Operators for preparing training data, their queries and the SQL twins of these.

Every operator takes a DataFrame of documents. Columns it does not need are ignored in reports
and carried unchanged by filters; helper columns get names the input does not use.
"""
