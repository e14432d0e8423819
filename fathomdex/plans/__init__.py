"""Query language and the compiler from syntax trees to columns."""
