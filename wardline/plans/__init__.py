"""The named datasets: one function per dataset, each returning a DataFrame.

Optional arguments narrow a dataset to one entity, date or word; without them
it covers all rows. Rows come unordered unless a limit is part of the dataset;
``wardline.plans.order.in_display_order`` sorts them for output.
"""
