"""Small hand-written sources."""

ORDER_API = """package org.shop.services.orders.controller;

import java.util.List;
import org.shop.services.orders.OrderStore;
import static org.shop.util.Money.*;

/**
 * Serves orders.
 *
 * <p>Read only.
 */
@RestController
@RequestMapping("/orders/")
public class OrderApi {

    private final OrderStore store;

    /** Wires the store. */
    public OrderApi(OrderStore store) { this.store = store; }

    /**
     * One order.
     */
    @GetMapping("/{id}")
    @Secured({"USER", "ADMIN"})
    public OrderView one(@PathVariable("id") final Long id) {
        if (id == null) {
            throw new IllegalArgumentException("if for while {");
        }
        for (int i = 0; i < 3; i++) {
            if (i == id) { return null; }
        }
        return null;
    }

    @RequestMapping(method = RequestMethod.POST, value = "search")
    Map<String, List<OrderView>> search(Map<String, int[]> filter, String... words) throws IOException, Oops {
        return run(new Task() {
            public void go() { }
        });
    }

    @PostMapping
    abstract void create(java.util.Date when, int[] sizes);
}
"""

NESTED = """package org.shop.dto;

public class Outer {
    public static class Left { int a() { return 1; } }

    interface Port { void send(String s); }

    enum Color { RED { int z() { return 0; } }, GREEN("x") {}; Color() {} Color(String s) {} }

    static final class Right<T extends Comparable<T>> implements Port {
        static { boot(); }
        Runnable r = () -> { tick(); };
        public <K, V> Map<K, V> pair(Map.Entry<K, V> e) { class Local { void l() {} } return null; }
        public void send(String s) {}
    }
    @interface Mark { int level() default 3; }
}
"""

ARROW = """package org.shop;

public class Painter {

    public void draw(Shape shape) {
        switch (shape.kind()) {
            case ROUND -> circle(shape);
            case SQUARE, BOX -> box(shape);
            default -> {
                log(shape);
                other(shape);
            }
        }
    }

    public int sides(Shape shape) {
        return shape.sides();
    }
}
"""

BROKEN = "public class {{{ this is no program"
