from querytrail.functions.domains import (domain_suffixes, label_count, normalize_domain,
                                          strip_url_to_domain, suffix_count)
from querytrail.functions.events import (classify_outcome, client_hash, is_blocked_action,
                                         is_nxdomain, is_present, is_servfail)
from querytrail.functions.reporting import (category_family, epoch_to_hour, label_null_keys,
                                            pct, risk_badge, risk_level, round_half_up,
                                            time_label)
from querytrail.functions.timewindow import (TimeWindow, filter_between, resolve_time_window,
                                             ts_literal)

__all__ = [n for n in dir() if not n.startswith("_")]
