"""catsim: Spark jobs for product-image catalogues."""
