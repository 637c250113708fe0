"""meritlens: product-value and review-trust analytics as Spark DataFrame operators."""
