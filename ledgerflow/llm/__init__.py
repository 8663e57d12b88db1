"""Training-data operators over document tables.

Each module holds one operator with a DataFrame -> DataFrame interface; ``queries`` applies them
to the driver tables.  Nothing outside this folder imports it except ``__spark_entry__``.

Conventions shared by all operators:

* a null text counts as the empty text; rows are never dropped because a column is null;
* only the named columns are read, so extra columns (also ones that share a name with an
  internal column, which all start with ``_``) neither crash nor change a result;
* repeated rows give repeated result rows, and equal rows give equal results;
* an empty table gives an empty result with the same schema.
"""
