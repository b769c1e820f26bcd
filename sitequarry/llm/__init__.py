"""Operators for building text collections from crawled pages. Nothing else in the library imports this subpackage."""
