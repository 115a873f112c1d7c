"""Schemas of station packages and of the index tables derived from them."""

from __future__ import annotations


def _struct(fields: str) -> str:
    """The columns of a DDL string as a struct type."""
    return f"struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in fields.split(', '))}>"


NODE = (
    "node_id string, type string, layer string, polygon_id string, position array<double>, source_position array<double>, zone_type string, zone_id string, "
    "zone_label string, node_key int, node_key_str string, connector_id string, connector_type string, endpoint string, exit_number string, asset_id string, "
    "asset_type string, label string, gate_type string, gate_side string, poi_type string, toilet_gender string, platform_id string, station_name string, "
    "line_id string, direction string, car int, door int, car_door string, elevator_id string, facing_angle_deg double, cost double"
)
EDGE = (
    "edge_id string, `from` string, `to` string, type string, bidirectional boolean, cost double, connector_id string, connector_type string, asset_id string, "
    "gate_type string, platform_id string, elevator_id string, exit_number string"
)
VIDEO_EDGE = (
    "edge_id string, video_title string, url string, r2_url string, from_node_key string, to_node_key string, route_edge_type string, connector_type string, "
    "transport_mode string, used_by_count int, video_required boolean"
)
METADATA = "station_id string, station_name string, line_ids array<string>, version string"
GRAPH = f"nodes array<{_struct(NODE)}>, edges array<{_struct(EDGE)}>"
VIDEOS = f"edges array<{_struct(VIDEO_EDGE)}>"
POLYGONS = (
    "color_groups array<struct<type: string, cluster_id: int, color_space: string, center: array<double>, pixel_count: bigint, "
    "morphology: struct<open_kernel: int, close_kernel: int>, polygon_count: int, polygons: array<array<array<array<int>>>>>>"
)
REQUEST_END = "struct<type: string, line_id: string, direction: string, platform_id: string, car: int, exit_number: string, facility_type: string, facility_subtype: string, label: string, node: string>"
ROUTE_REQUEST = f"request_id bigint, station_id string, start {REQUEST_END}, goal {REQUEST_END}, route_preference string, include_toilet boolean, toilet_gender string"
