"""DataFrame-to-DataFrame operators of the crawl data model."""
