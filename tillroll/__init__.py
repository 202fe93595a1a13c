"""Coupon and purchase-history analytics as Spark jobs."""
