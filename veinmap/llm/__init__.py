"""Training-data operators: token counts, filters, deduplication, packing, chat formatting.

Nothing outside this folder imports it.  Every operator takes a DataFrame and
the names of its key and text columns, selects only those columns (so extra
columns, whatever their names, never clash) and returns a DataFrame.
"""
