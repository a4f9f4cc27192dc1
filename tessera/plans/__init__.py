"""The library's queries over the supplied tables, and the SQL that checks them."""
