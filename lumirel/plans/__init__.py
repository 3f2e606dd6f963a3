"""The registered queries of the library, each with the SQL that it is held against."""
